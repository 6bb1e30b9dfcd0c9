"""Analytics over an organisation's message traffic, as PySpark DataFrame operators."""

from mailscope.config import CorpusConfig, Topic
from mailscope.plans.exchange import build_exchange
from mailscope.sources.tables import Sources, load_sources

__all__ = ["CorpusConfig", "Sources", "Topic", "build_exchange", "load_sources"]
