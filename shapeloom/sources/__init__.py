"""Where records come from."""

from .catalog import Catalog, ConfigError, Endpoint, Provider
from .documents import elements, parse_documents

__all__ = ["Catalog", "ConfigError", "Endpoint", "Provider", "elements", "parse_documents"]
