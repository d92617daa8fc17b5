"""A decision-rules engine on Spark: YAML rulesets become DataFrame plans."""

import sys

from pyspark import cloudpickle

from .engine import EngineConfig, Evaluation, RuleEngine
from .errors import ConfigError, IngestError, LookupLoadError, ParseError, RuleEngineError, SchemaError

# functions travel to executors whole, so these need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
__all__ = ["ConfigError", "EngineConfig", "Evaluation", "IngestError", "LookupLoadError", "ParseError", "RuleEngine", "RuleEngineError", "SchemaError"]
