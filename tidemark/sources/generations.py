"""Tables kept by a stream as generations of folders under a manifest.

Each micro-batch adds one folder; ``fan`` folders of a level are folded into one of the next, so a batch costs its own
rows and, spread over all batches, a logarithm of rewriting, and about ``fan`` folders a level are all there is.  The
manifest names the folders that make up the table.  It is written last, under a new number, and never changed: a reader
takes the newest one and sees a whole state, a writer that dies leaves the old one.  Folders go once neither of the two
newest manifests names them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

FAN = 8
KEPT_MANIFESTS = 2

Parts = Mapping[str, DataFrame]


class Generations:
    """``combine`` makes one generation of several: from the parts of all of them, by name, to parts of the same names."""

    def __init__(self, spark: SparkSession, path: str, combine: Callable[[Parts], Parts], fan: int = FAN):
        self.spark, self.path, self.combine, self.fan = spark, path, combine, fan
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names)))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """``number``, ``last`` (batch) and ``entries`` (name and level, oldest first) of the newest manifest, or of one."""
        numbers = self._numbers()
        if not numbers:
            return {"number": -1, "last": -1, "entries": []}
        text = self.spark.read.text(str(self._at("manifests", str(numbers[-1] if number is None else number)))).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        draft, final = self._at("manifests", f"{manifest['number']}.draft"), self._at("manifests", str(manifest["number"]))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise OSError(f"another writer has published {final}")

    def _write(self, name: str, parts: Parts) -> None:
        for part, df in parts.items():
            df.write.mode("overwrite").parquet(f"{self.path}/data/{name}/{part}")

    def _load(self, entries: list[dict]) -> dict[str, DataFrame]:
        parts: dict[str, list[DataFrame]] = {}
        for e in entries:
            for part in e["parts"]:
                parts.setdefault(part, []).append(self.spark.read.parquet(f"{self.path}/data/{e['name']}/{part}"))
        return {part: reduce(DataFrame.unionByName, frames) for part, frames in parts.items()}

    def add(self, batch_id: int, parts: Parts) -> None:
        """Add a batch; one that the manifest has already changes nothing."""
        now = self.manifest()
        if batch_id <= now["last"]:
            return
        self._write(f"batch-{batch_id}", parts)
        entries = [*now["entries"], {"name": f"batch-{batch_id}", "level": 0, "parts": sorted(parts)}]
        level = 0
        while True:
            own = [e for e in entries if e["level"] == level]
            if len(own) < self.fan:
                break
            # Entries of a level lie side by side: older ones are of a higher level.
            folded = {"name": f"fold-{batch_id}-{level + 1}", "level": level + 1, "parts": sorted(parts)}
            self._write(folded["name"], self.combine(self._load(own)))
            at = entries.index(own[0])
            entries = [*entries[:at], folded, *entries[at + len(own):]]
            level += 1
        self._publish({"number": now["number"] + 1, "last": batch_id, "entries": entries})
        self._clean()

    def _clean(self) -> None:
        numbers = self._numbers()
        for n in numbers[:-KEPT_MANIFESTS]:
            self._fs.delete(self._at("manifests", str(n)), False)
        named = {e["name"] for n in numbers[-KEPT_MANIFESTS:] for e in self.manifest(n)["entries"]}
        for name in self._names("data"):
            if name not in named:
                self._fs.delete(self._at("data", name), True)

    def read(self) -> dict[str, DataFrame] | None:
        """The parts of the newest state, combined; None before the first batch."""
        entries = self.manifest()["entries"]
        return dict(self.combine(self._load(entries))) if entries else None
