"""Session-transcript and token-usage analytics as lazy DataFrame operators."""

from turnledger.config import EngineConfig, PlanPeriod
from turnledger.session import build_session

__all__ = ["EngineConfig", "PlanPeriod", "build_session"]
