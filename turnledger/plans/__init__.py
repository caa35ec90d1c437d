"""Subscription plans: billing cycles, comparison, recommendation, currency."""
