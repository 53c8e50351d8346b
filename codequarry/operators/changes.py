"""Processing only new or changed records.

The state of the last successful run, one hash per key, is kept as a base and the changes of the runs since (at most ``COMPACT``), each
a Parquet table in a folder of its own attempt.  A run hashes its current rows, joins them with the state of its scopes and writes only
what is new, changed or struck; every ``COMPACT`` runs a new base is written too.  Then it commits: a file named by the next number,
which names the folders of the state, is put in place by a rename that fails if the number is taken.  A run that dies before that leaves
a folder nobody reads, so no record is skipped.  A run that finds its number taken starts over on the state of the other one, so no run is
lost.  Every committed run has a token; a run whose token is committed does nothing, however old it is, so no record is repeated.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from codequarry.plans.workspace import FileStore, materialised, new_folder

#: After so many runs the state is written as one table again.
COMPACT = 8
#: A run that finds its number taken starts over so often.
ATTEMPTS = 20
_DELTA = "scope string, key string, hash string, alive boolean, changed boolean, tag long, version long"


def content_hash(*columns: str | Column) -> Column:
    """SHA-256 over the given columns of a row; null and '' differ, and so do ('a','b') and ('ab','')."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.sha2(F.to_json(F.struct(*[c.cast("string").alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


class ChangeTracker:
    """Commits and tables of the state below ``root``: ``commits/<number>.json``, ``tokens/<digest>``, ``data/<folder>``.

    ``apply`` takes one row per (scope, key): a *scope* is what one run covers (a repository), a null ``hash`` is a
    key that was seen but could not be read.  Defined cases: a seen key without a hash keeps the hash on record; a key
    of a scope in this run that was not seen is struck from the record if the scope's run was complete, else kept;
    scopes that are not in this run keep their record, and readings of theirs are left out; empty readings or an empty state are
    ordinary inputs.
    """

    POINTER = "CURRENT"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._files = spark, root.rstrip("/"), FileStore(spark, root)

    @staticmethod
    def _commit_name(number: int) -> str:
        return f"commits/{number:09d}.json"

    def commit_of(self, number: int) -> dict | None:
        """{version, token, base, deltas, changes} of a committed run; base and deltas are folders of the state after it."""
        text = self._files.read_text(self._commit_name(number)) if number else None
        return json.loads(text) if text else None

    def pointer(self) -> dict:
        """The last commit.  The pointer file is a hint where to look; commits behind it are found by their number."""
        number = int(self._files.read_text(self.POINTER) or 0)
        found = self.commit_of(number)
        while later := self.commit_of((found["version"] if found else 0) + 1):
            found = later
        return found or {"version": 0, "token": None, "base": None, "deltas": [], "changes": None}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _DELTA)
        return self.spark.read.schema(_DELTA).parquet(*(f"{self.root}/data/{f}" for f in folders))

    def _state(self, at: dict) -> DataFrame:
        if not at["deltas"]:
            return self._read([at["base"]] if at["base"] else [])
        rows = self._read([*([at["base"]] if at["base"] else []), *at["deltas"]])
        last = F.max_by(F.struct("hash", "alive"), "version").alias("last")
        return rows.groupBy("scope", "key").agg(last).where("last.alive").select("scope", "key", "last.hash")

    def state(self) -> DataFrame:
        """(scope, key, hash) on record after the last committed run."""
        return self._state(self.pointer()).select("scope", "key", "hash")

    def changes(self, first: int, last: int | None = None) -> DataFrame:
        """(tag, scope, key, hash) that the runs of these versions (first to last) found new or changed."""
        commits = [self.commit_of(n) for n in range(first, (first if last is None else last) + 1)]
        return self._read([c["changes"] for c in commits if c]).where("changed").select("tag", "scope", "key", "hash")

    def _token_name(self, token: str) -> str:
        return f"tokens/{hashlib.sha256(token.encode()).hexdigest()}"

    def committed(self, token: str) -> int | None:
        """The version that a run of this token was committed as."""
        at = self.pointer()
        if at["token"] == token:
            return at["version"]
        text = self._files.read_text(self._token_name(token))
        return int(text) if text else None

    def apply(self, readings: DataFrame, scopes: DataFrame, token: str) -> int:
        """Run once; gives the committed version.

        readings: (scope, key, hash), one row per key.  scopes: (scope, complete, tag), the scopes of this run.
        token: names this run; a repetition with a committed token does nothing.
        """
        for _ in range(ATTEMPTS):
            at = self.pointer()
            if at["token"] is not None:  # whoever comes next sees to it that the token of the last commit can be found
                self._files.create_text(self._token_name(at["token"]), str(at["version"]))
            if (version := self.committed(token)) is not None:
                return version
            number = at["version"] + 1
            folder = f"{number:09d}-{uuid.uuid4().hex}"
            found = compared(self._state(at), readings, scopes).withColumn("version", F.lit(number).cast("long"))
            found.write.parquet(f"{self.root}/data/{folder}")
            commit = {"version": number, "token": token, "base": at["base"], "deltas": [*at["deltas"], folder], "changes": folder}
            if len(commit["deltas"]) >= COMPACT:
                base = f"{number:09d}-base-{uuid.uuid4().hex}"
                whole = self._state(commit).selectExpr("scope", "key", "hash", "true AS alive", "false AS changed", "CAST(NULL AS LONG) AS tag", f"CAST({number} AS LONG) AS version")
                whole.write.parquet(f"{self.root}/data/{base}")
                commit |= {"base": base, "deltas": []}
            if self._files.create_text(self._commit_name(number), json.dumps(commit)):
                self._files.create_text(self._token_name(token), str(number))
                self._files.replace_text(self.POINTER, str(number))
                return number
            for lost in {folder, commit["base"]} - {at["base"]} - {None}:
                self._files.remove(f"data/{lost}")
        raise RuntimeError(f"run {token} found its number taken {ATTEMPTS} times")

    def forget_before(self, version: int) -> None:
        """Delete the tables of commits before ``version`` that the last state does not need; their changes cannot be read any more."""
        at = self.pointer()
        needed = {at["base"], *at["deltas"]}
        for number in range(min(version, at["version"]) - 1, 0, -1):
            commit = self.commit_of(number)
            lost = {commit["changes"], commit["base"]} - needed - {None}
            if not any([self._files.remove(f"data/{name}") for name in lost]) and lost:
                break  # older ones are gone already


def compared(state: DataFrame, readings: DataFrame, scopes: DataFrame) -> DataFrame:
    """What one run changes of the state: new and changed rows (``changed``) and struck ones (not ``alive``)."""
    own = scopes.select("scope", "complete", "tag")
    on_record = state.select("scope", "key", F.col("hash").alias("old")).join(own, "scope")
    seen = readings.select("scope", "key", F.col("hash").alias("new"), F.lit(True).alias("seen")).join(own, "scope")
    a, b = on_record.alias("a"), seen.alias("b")
    both = a.join(b, (F.col("a.scope") == F.col("b.scope")) & (F.col("a.key") == F.col("b.key")), "full_outer")
    first = {c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in ("scope", "key", "tag", "complete")}
    changed = F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    struck = F.col("seen").isNull() & F.coalesce(first["complete"], F.lit(True))
    rows = both.select(*(first[c].alias(c) for c in ("scope", "key")), F.coalesce("new", "old").alias("hash"), (~struck).alias("alive"), changed.alias("changed"), first["tag"].alias("tag"))
    return rows.where("changed OR NOT alive")


def ok_runs(runs: DataFrame) -> DataFrame:
    """(run_id, repo, step, complete): the successful runs, numbered per repository by start (ties by run_id)."""
    order = Window.partitionBy("repo").orderBy("started_at", "run_id")
    return (
        runs.where("status = 'ok'")
        .select("run_id", "repo", "started_at", (~F.coalesce("walk_had_errors", F.lit(False))).alias("complete"))
        .dropDuplicates(["run_id"])
        .withColumn("step", F.row_number().over(order))
        .drop("started_at")
    )


def run_readings(scans: DataFrame) -> DataFrame:
    """(run_id, path, hash): a run's last non-null hash of a path by scanned_at (ties by scan_id), null if it read none."""
    read = F.when(F.col("hash").isNotNull(), F.struct("scanned_at", "scan_id", "hash"))
    return scans.groupBy("run_id", "path").agg(F.max(read)["hash"].alias("hash"))


def replay(runs: DataFrame, scans: DataFrame, root: str | None = None) -> tuple[ChangeTracker, DataFrame]:
    """Feed the whole history of runs through a ChangeTracker; (tracker, (run_id, path) of all changes).

    Step k takes the k-th successful run of *every* repository at once, so the number of steps is the longest history
    of one repository, not the number of runs.  Readings are written once, laid out by step; each step reads its slice.
    Null paths are no records and are left out; rows of unknown or unsuccessful runs leave the record as it is.
    """
    spark = runs.sparkSession
    good = materialised(ok_runs(runs), "ok-runs")
    steps = good.agg(F.max("step")).first()[0] or 0
    readings = materialised(
        run_readings(scans.select("run_id", "path", "hash", "scanned_at", "scan_id").where("path is not null").join(good.select("run_id"), "run_id", "left_semi"))
        .join(good.select("run_id", "repo", "step"), "run_id")
        .select("step", F.col("repo").alias("scope"), F.col("path").alias("key"), "hash"),
        "readings", "step",
    )
    tracker = ChangeTracker(spark, root or new_folder(spark, "changes"))
    first = tracker.pointer()["version"] + 1
    for step in range(1, steps + 1):
        scopes = good.where(F.col("step") == step).select(F.col("repo").alias("scope"), "complete", F.col("run_id").alias("tag"))
        tracker.apply(readings.where(F.col("step") == step), scopes, f"step-{step}")
    found = tracker.changes(first, first + steps - 1) if steps else tracker.changes(1, 0)
    return tracker, found.select(F.col("tag").alias("run_id"), F.col("key").alias("path"))
