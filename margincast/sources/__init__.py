from margincast.sources.tables import (SOURCE_FILES, SOURCE_SCHEMAS, read_sources,
                                       check_sources, write_result)
from margincast.sources.driver_tables import load_driver_sources, ORACLE_SOURCES_SQL
from margincast.sources.model_store import save_model, load_model

__all__ = ["SOURCE_FILES", "SOURCE_SCHEMAS", "read_sources", "check_sources",
           "write_result", "load_driver_sources", "ORACLE_SOURCES_SQL",
           "save_model", "load_model"]
