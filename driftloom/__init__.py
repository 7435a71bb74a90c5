"""A PySpark engine for declarative event data."""

from driftloom.errors import ConfigurationError
from driftloom.operators.generate import Generator, StreamOrchestrator
from driftloom.plans.spec import Config, load_config, load_config_from_dict
from driftloom.streaming.record_sink import KinesisDataSource, RecordSink

__version__ = "0.1.0"
__all__ = [
    "Config",
    "ConfigurationError",
    "Generator",
    "KinesisDataSource",
    "RecordSink",
    "StreamOrchestrator",
    "__version__",
    "load_config",
    "load_config_from_dict",
]
