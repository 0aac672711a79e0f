"""A SQL dialect, a fluent builder and pluggable sources over Spark DataFrames."""

from .builder import QueryBuilder
from .session import DataSet, Query, replace_views, ship
from .sources.base import Frames, Source
from .sources.codecs import decodes
from .sources.memory import Dicts
from .sources.storage import Jdbc, Locations, Parquet
from .sources.tree import Trees

__all__ = ["DataSet", "Dicts", "Frames", "Jdbc", "Locations", "Parquet", "Query", "QueryBuilder", "Source", "Trees", "decodes", "replace_views", "ship"]
