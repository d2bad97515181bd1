"""Stored results: named tables whose every version is a list of Parquet folders; rows that are there are never written again."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.operators.reshape import islands_in
from foliospark.sources.tables import appended


def safe(name: str) -> str:
    """As strings.safe_name, of one name; letters and digits of any script stay."""
    return re.sub(r"[^\w\-]", "_", name.strip()).strip("_") or "table"


class Store:
    """Tables in a folder that driver and executors share.

    root/data/<id> holds rows, root/tables/<name>/<n>.json which of them make version n (null: no table). A version appears by
    one rename that fails if another writer was first, so readers see a whole version or the one before, and of two writers
    one gets FileExistsError and may try again. Folders that no version names are left by writers that broke off.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._hadoop.Path(self.root).getFileSystem(self._conf)

    def _list(self, folder: str) -> list[str]:
        path = self._hadoop.Path(folder)
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def versions(self, name: str) -> list[int]:
        names = self._list(f"{self.root}/tables/{safe(name)}")
        return sorted(int(n[:-5]) for n in names if re.fullmatch(r"\d+\.json", n))

    def _parts(self, name: str, version: int | None = None) -> list[str] | None:
        known = self.versions(name)
        if version is not None and version not in known:
            raise FileNotFoundError(f"{safe(name)} has no version {version}")
        if not known:
            return None
        at = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.root}/tables/{safe(name)}/{at}.json", wholetext=True).first()[0])

    def _switch(self, name: str, parts: list[str] | None, after: int) -> None:
        folder = f"{self.root}/tables/{safe(name)}"
        draft, target = self._hadoop.Path(f"{folder}/.{uuid.uuid4().hex}"), self._hadoop.Path(f"{folder}/{after + 1}.json")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        kind = getattr(self._hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            self._hadoop.FileContext.getFileContext(self._files.getUri(), self._conf).rename(draft, target, options)
        except Exception as e:
            self._files.delete(draft, False)
            if self._files.exists(target):
                raise FileExistsError(f"{safe(name)} has got version {after + 1} from another writer") from e
            raise

    def _last(self, name: str) -> int:
        return (self.versions(name) or [-1])[-1]

    def tables(self) -> list[str]:
        return sorted(n for n in self._list(f"{self.root}/tables") if self._parts(n) is not None)

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """All rows, columns of any part by name, missing ones null; a column whose type differs between parts is text. No
        columns and no rows for a table that isn't there."""
        parts = self._parts(name, version)
        if not parts:
            return self.spark.range(0).select()
        read = [self.spark.read.parquet(f"{self.root}/data/{p}") for p in parts]
        kinds: dict[str, set[str]] = {}
        for df in read:
            for c, kind in df.dtypes:
                kinds.setdefault(c, set()).add(kind)
        mixed = [c for c, k in kinds.items() if len(k) > 1]
        return reduce(appended, (df.withColumns({c: F.col(f"`{c}`").cast("string") for c in mixed if c in df.columns}) for df in read))

    def save(self, name: str, df: DataFrame, mode: str = "new") -> DataFrame:
        """mode new: df is the table; append: its rows come to those that are there. Returns the whole table."""
        if mode not in ("new", "append"):
            raise ValueError(f"mode {mode} is neither new nor append")
        last = self._last(name)
        before = self._parts(name) if mode == "append" and last >= 0 else None
        part = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{part}")
        self._switch(name, [*(before or []), part], last)
        return self.load(name, last + 1)

    def delete(self, name: str) -> None:
        """Nothing happens if there is no such table; earlier versions can still be read by number."""
        if self._parts(name) is not None:
            self._switch(name, None, self._last(name))

    def rename(self, old: str, new: str) -> str:
        """The new name as it is stored. The new table appears before the old one goes; rows aren't copied."""
        parts = self._parts(old)
        if parts is None:
            raise FileNotFoundError(f"there is no table {safe(old)}")
        if safe(new) != safe(old):
            if self._parts(new) is not None:
                raise ValueError(f"there is a table {safe(new)} already")
            self._switch(new, parts, self._last(new))
            self.delete(old)
        return safe(new)


def spans(df: DataFrame, part: str, key: str, order: str) -> DataFrame:
    """df with block, place and rowspan: how many rows the first row's cell of a run of equal keys covers, 0 for covered ones.
    Runs lie within a part; order is unique there. Null keys are equal to each other."""
    size = F.count("*").over(Window.partitionBy(part, "block"))
    return islands_in(df, part, key, order).withColumn("rowspan", F.when(F.col("place") == 1, size).otherwise(0))


def mergeable(spanned: DataFrame, columns: list[str]) -> DataFrame:
    """column, mergeable: whether it holds values only on the first row of each run, as of `spans`; one aggregate over all."""
    later = [F.max((F.col("place") > 1) & F.col(c).isNotNull()).alias(c) for c in columns]
    packed = F.array(*(F.struct(F.lit(c).alias("column"), (~F.coalesce(c, F.lit(False))).alias("mergeable")) for c in columns))
    return spanned.agg(*later).select(F.explode(packed).alias("m")).select("m.*")
