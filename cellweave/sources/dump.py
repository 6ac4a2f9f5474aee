"""What one run holds: its footer and every cell with its decoded key, in key order.

``python -m cellweave.sources.dump ROOT RUN``
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.codec import to_text
from ..schema import ADDRESS
from .store import FORMAT, Store


def dump(store: Store, file_id: int) -> tuple[dict, DataFrame]:
    """(footer, cells): cells have key (its parts joined by ``_``), val, tom and seq. The run is checked first."""
    run = store.check(file_id)
    files = [(n, size) for n, size, _ in store.files.listing(run.path) if n.endswith(".parquet")]
    footer = {"path": run.path, "files": len(files), "entry_count": run.entry_count, "format_version": FORMAT, "lowest_sequence": run.min_sequence, "highest_sequence": run.max_sequence, "size_bytes": run.size_bytes}
    key = F.concat_ws("_", *(to_text(F.col(c)) for c in ADDRESS))
    cells = store.run_scan(file_id).select(key.alias("key"), F.coalesce(to_text(F.col("value")), F.lit("")).alias("val"), F.col("is_tombstone").alias("tom"), F.col("sequence").alias("seq"))
    return footer, cells


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) != 2 or not args[1].isdigit():
        print("usage: python -m cellweave.sources.dump ROOT RUN", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        footer, cells = dump(Store.open(spark, args[0], recover=False), int(args[1]))
    except StoreError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"[RUN] {args[1]}\n[FOOTER]")
    for name, value in footer.items():
        print(f"{name}: {value}")
    print("[DATA]")
    for r in cells.toLocalIterator():
        print(f"[ENCODED] key: {r['key']}   val: {r['val']}  tom: {str(r['tom']).lower()}  seq: {r['seq']}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
