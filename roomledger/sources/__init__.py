"""Where the inputs come from: Parquet, CSV and JDBC tables, or an adapted star schema."""

from roomledger.sources.inputs import Inputs

__all__ = ["Inputs"]
