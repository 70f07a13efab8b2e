"""Reading tables and cutting lineage."""

from weftgraph.sources.tables import read_table, scope, scratch_folder, stage, staged_rows, small_side

__all__ = ["read_table", "scope", "scratch_folder", "small_side", "stage", "staged_rows"]
