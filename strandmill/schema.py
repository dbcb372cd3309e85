"""Record flavors of BED data, their column layouts, and dataset manifests."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column names, order and limits of the published table layout.
INT32_MAX = 2_147_483_647
LOCUS = ("Chromosome", "Start", "End")
DERIVED = "MaxEndSoFar"
PAYLOAD = {
    "BED3": (),
    "BED4": ("Name",),
    "BED5": ("Name", "Score"),
    "BED6": ("Strand", "Name", "Score"),
    "BED12": ("Strand", "Name", "Score", "ThickStart", "ThickEnd", "ItemRgb", "BlockCount", "BlockSizes", "BlockStarts"),
    "BED_PLUS": ("Tail",),
    "COLLAPSED": ("Score",),
}
INTEGER_COLUMNS = ("ThickStart", "ThickEnd", "BlockCount")
SORT_KEYS = ["Chromosome", "Start", "End"]
FORMAT_VERSION = 2
INDEX_VERSION = "2"
ROW_GROUP = 65_536


class BedError(ValueError):
    """Input or options that the data model rejects."""


def flavor_of(columns: int) -> str:
    """The flavor of records with so many columns."""
    if columns < 3:
        raise BedError(f"a record needs 3 columns, not {columns}")
    return {3: "BED3", 4: "BED4", 5: "BED5", 6: "BED6", 12: "BED12"}.get(columns, "BED_PLUS")


def columns_of(flavor: str) -> list[str]:
    return [*LOCUS, *PAYLOAD[flavor], DERIVED]


def coordinate_type(coord_dtype: str) -> T.DataType:
    if coord_dtype not in ("int32", "int64"):
        raise BedError(f"coord_dtype is int32 or int64, not {coord_dtype}")
    return T.IntegerType() if coord_dtype == "int32" else T.LongType()


def struct_of(flavor: str, coord_dtype: str = "int32") -> T.StructType:
    """The Spark schema of a flavor; the file's columns are never null."""
    position = coordinate_type(coord_dtype)
    kinds = {"Start": position, "End": position, DERIVED: position, **dict.fromkeys(INTEGER_COLUMNS, T.IntegerType())}
    if flavor == "COLLAPSED":
        kinds["Score"] = T.DoubleType()
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType()), False) for c in columns_of(flavor)])


@dataclass
class Manifest:
    """What a locus dataset says of itself in its footer."""

    row_count: int
    chromosomes: list[dict]
    schema_columns: list[dict]
    writer_version: str
    created_utc: str
    coord_dtype: str = "int32"
    row_group_size: int = ROW_GROUP
    extra: dict = field(default_factory=dict)

    def as_json(self) -> dict:
        return {
            "format_version": FORMAT_VERSION,
            "writer_version": self.writer_version,
            "created_utc": self.created_utc,
            "row_count": self.row_count,
            "chromosomes": self.chromosomes,
            "schema_columns": self.schema_columns,
            "sort_keys": SORT_KEYS,
            "row_group_size": self.row_group_size,
            "data_page_version": "2.0",
            "default_compression": ["zstd", 3],
            "coord_dtype": self.coord_dtype,
            **self.extra,
        }
