"""The event log as a Python data source with positions for offsets: a micro-batch is a range (tx, offset].

``spark.dataSource.register(OutboxSource)``, then ``spark.readStream.format("outbox").option("path", folder)``. The
folder holds parquet files of the log; options ``tx`` and ``offset`` say after which position to start. For large
batches the parquet stream of ``streaming.catchup`` reads in parallel; this source gives exact positions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "transaction_id DECIMAL(20,0), log_offset BIGINT, msg_uuid STRING, payload BINARY, metadata STRING"


class Range(InputPartition):
    """A file and the positions after which, and up to which, its rows are read."""

    def __init__(self, file: str, start: tuple[int, int], end: tuple[int, int]) -> None:
        self.file, self.start, self.end = file, start, end


def _after(start: tuple[int, int]):
    import pyarrow.compute as pc
    from decimal import Decimal

    tx, off = pc.field("transaction_id"), pc.field("log_offset")
    return (tx > Decimal(start[0])) | ((tx == Decimal(start[0])) & (off > start[1]))


class OutboxReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.first = {"tx": str(options.get("tx", 0)), "offset": int(options.get("offset", 0))}
        self.spans: dict[str, tuple[tuple[int, int], tuple[int, int]] | None] = {}

    def _files(self) -> list[str]:
        import pyarrow.dataset as ds

        return ds.dataset(self.path, format="parquet").files

    def initialOffset(self) -> dict:
        return self.first

    def _span(self, file: str):
        """The first and last position of a file, which is read once: a file of the log does not change."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        if file not in self.spans:
            t = pq.read_table(file, columns=["transaction_id", "log_offset"])
            ends = []
            for of in (pc.min, pc.max) if t.num_rows else ():
                tx = of(t.column("transaction_id")).as_py()
                ends.append((int(tx), of(t.filter(pc.equal(t.column("transaction_id"), tx)).column("log_offset")).as_py()))
            self.spans[file] = tuple(ends) or None
        return self.spans[file]

    def latestOffset(self) -> dict:
        """The largest position there is; only files that have come since the last call are looked into."""
        ends = [s[1] for s in map(self._span, self._files()) if s]
        best = max([(int(self.first["tx"]), self.first["offset"]), *ends])
        return {"tx": str(best[0]), "offset": best[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        a, z = ((int(x["tx"]), int(x["offset"])) for x in (start, end))
        return [Range(f, a, z) for f in self._files() if (s := self._span(f)) and s[1] > a and s[0] <= z]

    def read(self, partition: Range) -> Iterator:
        import pyarrow.parquet as pq

        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        t = pq.read_table(partition.file, columns=columns, filters=_after(partition.start) & ~_after(partition.end))
        yield from t.sort_by([("transaction_id", "ascending"), ("log_offset", "ascending")]).to_batches()

    def commit(self, end: dict) -> None:
        pass


class OutboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> OutboxReader:
        return OutboxReader(self.options)
