"""A registry of runs: folders named by time, published whole or not at all.

A run is written under a draft name.  Publishing moves it to its own name by one
rename and then takes the next entry of the log, an empty file whose creation fails
if another writer has it; a reader goes by the log, newest entry first, and never
looks at a folder that the log doesn't name.  A writer that loses an entry takes the
next one, unless it asked for that one."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.loops import COMPARED
from tessera.storage import hadoop_path

LOG, DRAFT, INFO = "_log", "_draft", "run.json"


class Taken(RuntimeError):
    """Another writer has published in between."""


def run_name(now: datetime | None = None) -> str:
    """A name that sorts by time: date, time and eight hexadecimal digits."""
    return f"{(now or datetime.now()):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


class Registry:
    """Runs below *root*, a folder that driver and executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _entries(self) -> list[tuple[int, str]]:
        """(number, run) of the log, newest first: an entry for each run."""
        fs, log = hadoop_path(self.spark, f"{self.root}/{LOG}")
        if not fs.exists(log):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(log)]
        out = []
        for name in names:
            number, _, run = name.partition("-")
            if number.isdigit() and run:
                out.append((int(number), run))
        return sorted(out, reverse=True)

    def version(self) -> int:
        """The newest entry's number; 0 before the first."""
        return max((n for n, _ in self._entries()), default=0)

    def _take(self, number: int, run: str) -> bool:
        """Makes the log's entry of a number: a claim first, which one writer alone
        can create, then the entry with the run's name."""
        fs, claim = hadoop_path(self.spark, f"{self.root}/{LOG}/claim-{number:012d}")
        try:
            fs.create(claim, False).close()
        except Exception as e:  # noqa: BLE001  the file layer's own kinds
            if fs.exists(claim):
                return False
            raise e
        _, entry = hadoop_path(self.spark, f"{self.root}/{LOG}/{number:012d}-{run}")
        fs.create(entry, False).close()
        return True

    def publish(self, tables: dict[str, DataFrame], after: int | None = None, name: str | None = None, **settings) -> str:
        """Writes a run's tables and settings and publishes it; gives its name. With
        *after*, only if the newest entry still has that number; Taken otherwise,
        and nothing is left. A run of no tables has its settings alone."""
        run = name or run_name()
        draft = f"{self.root}/{DRAFT}/{uuid.uuid4().hex}"
        fs, path = hadoop_path(self.spark, draft)
        rows = {}
        for key, df in tables.items():
            df.write.parquet(f"{draft}/{key}")
            rows[key] = self.spark.read.schema(df.schema).parquet(f"{draft}/{key}").count()
        info = {"run": run, "tables": rows, "settings": settings, "timestamp": datetime.now().isoformat()}
        fs.mkdirs(path)
        out = fs.create(hadoop_path(self.spark, f"{draft}/{INFO}")[1])
        out.write(bytearray(json.dumps(info, default=str, sort_keys=True).encode()))
        out.close()
        _, whole = hadoop_path(self.spark, f"{self.root}/{run}")
        if fs.exists(whole) or not fs.rename(path, whole):
            fs.delete(path, True)
            raise Taken(run)
        number = self._last_claim() if after is None else after
        while not self._take(number + 1, run):
            if after is not None:
                fs.delete(whole, True)
                raise Taken(f"entry {number + 1}")
            number += 1
        return run

    def _last_claim(self) -> int:
        fs, log = hadoop_path(self.spark, f"{self.root}/{LOG}")
        names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
        return max((int(x[6:]) for x in names if x.startswith("claim-")), default=0)

    def runs(self) -> list[str]:
        """Published runs, newest first."""
        return [run for _, run in self._entries()]

    def newest(self) -> str | None:
        return next(iter(self.runs()), None)

    def info(self, run: str | None = None) -> dict:
        """Name, tables with their rows, settings and time, without a look at the
        tables; of the newest run, if none is named."""
        run = self._published(run)
        return json.loads(self.spark.read.text(f"{self.root}/{run}/{INFO}", wholetext=True).first()[0])

    def table(self, key: str, run: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self._published(run)}/{key}")

    def _published(self, run: str | None) -> str:
        known = self.runs()
        if not known or run is not None and run not in known:
            raise FileNotFoundError(run or "no run has been published")
        return run or known[0]

    def drift(self, run: str | None = None, compared: tuple[str, ...] = COMPARED, **settings) -> list[str]:
        """What differs between a run's settings and those now."""
        old = self.info(run)["settings"]
        return [f"{k}: {old.get(k)} then, {settings.get(k)} now" for k in compared if (k in old or k in settings) and old.get(k) != settings.get(k)]

    def resumed(self, run: str | None = None, strict: bool = False, **settings) -> tuple[dict, list[str]]:
        """(info, warnings) of the run to go on with; raises on drift, if strict."""
        changed = self.drift(run, **settings)
        if changed and strict:
            raise ValueError("; ".join(changed))
        return self.info(run), changed
