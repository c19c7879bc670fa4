"""Making all vectors anew: a run that can be stopped anywhere, and a swap that readers see whole or not at all.

Items fall into parts by their ids. A finished part is one folder of staged vectors and one
line in the run's log, with a digest of its items' ids and texts. A run that goes on looks
at the digests again: parts that are as they were are left alone, parts whose items came,
went or changed are rewound to what has changed in them, and unfinished ones begin. When all
parts fit the items that there are at that moment, and none failed, one commit makes the
staged folders the next version of the vectors, with the identity of their model. Until
then readers have the old version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.inference import Calls, Embed, inferred
from corpusloom.sources.storage import Version, Versions

STAGED = "id string, fingerprint string, embedding array<float>, error string"


@dataclass(frozen=True)
class Progress:
    """What a run has done: parts finished, how many of them in this run, items, those embedded in this run, those that failed."""

    parts: int
    finished: int
    ran: int
    items: int
    embedded: int
    failed: int
    committed: int | None = None


@dataclass
class Reembedding:
    """A run under a folder, with the vectors that it makes; ``identity`` names the model (provider, model, version and so on)."""

    spark: SparkSession
    path: str
    identity: dict[str, str]
    parts: int = 16

    @property
    def vectors(self) -> Versions:
        return Versions(self.spark, f"{self.path}/vectors")

    @property
    def log(self) -> Versions:
        return Versions(self.spark, f"{self.path}/run")

    def current(self) -> DataFrame | None:
        """id and embedding of the committed version."""
        rows = self.vectors.read("vectors")
        return None if rows is None else rows.select("id", "embedding")

    def marked(self, items: DataFrame) -> DataFrame:
        """Items with their fingerprints and parts."""
        return items.select("id", "text").withColumns({"fingerprint": F.sha2(F.coalesce("text", F.lit("")), 256), "part": F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")})

    def digests(self, items: DataFrame) -> dict[int, str]:
        """For each part, what its items are: a sum that doesn't depend on their order, and their number."""
        each = F.xxhash64("id", "fingerprint").cast("decimal(20,0)"), F.xxhash64("fingerprint", "id").cast("decimal(20,0)")
        own = self.marked(items).groupBy("part").agg(F.concat_ws(":", F.sum(each[0]), F.sum(each[1]), F.count("*")).alias("digest"))
        found = {r["part"]: r["digest"] for r in own.collect()}  # a row for each part
        return {p: found.get(p, "0") for p in range(self.parts)}

    def state(self) -> Version:
        """The newest entry of the log, if it is of this identity and these parts; else the beginning of another run."""
        last = self.log.at()
        if last.notes.get("identity") == self.identity and last.notes.get("parts") == self.parts:
            return last
        return Version(last.number, {}, {"identity": self.identity, "parts": self.parts, "done": {}})

    def run(self, read_items: Callable[[], DataFrame], embed: Embed, how: Calls = Calls(), most_parts: int | None = None) -> Progress:
        """Go on with what is left, and commit if all fits; ``read_items`` gives id and text as they are now.

        ``most_parts`` ends a run early, as a cancelled one does.
        """
        wanted = self.digests(read_items())
        state = self.state()
        left = [p for p in range(self.parts) if state.notes["done"].get(str(p), {}).get("digest") != wanted[p] or state.notes["done"][str(p)]["failed"]]
        ran = embedded = 0
        for part in left[: most_parts if most_parts is not None else len(left)]:
            state, made = self.finish(part, read_items(), embed, how, state)
            ran, embedded = ran + 1, embedded + made
        done = state.notes["done"]
        now = self.digests(read_items())
        fit = [p for p in range(self.parts) if done.get(str(p), {}).get("digest") == now[p]]
        failed = sum(done[str(p)]["failed"] for p in fit)
        items = sum(done[str(p)]["items"] for p in fit)
        version = self.commit(state).number if len(fit) == self.parts and not failed else None
        return Progress(self.parts, len(fit), ran, items, embedded, failed, version)

    def finish(self, part: int, items: DataFrame, embed: Embed, how: Calls, state: Version) -> tuple[Version, int]:
        """One part: what is staged and unchanged stays, the rest is embedded; the next entry of the log."""
        own = self.marked(items).filter(F.col("part") == part)
        before = state.notes["done"].get(str(part), {}).get("folder")
        tables = {k: list(v) for k, v in state.tables.items()}
        kept = self.spark.createDataFrame([], STAGED)
        if before:
            staged = self.log.read("staged", Version(tables={"staged": [before]})).filter("error is null")
            kept = staged.join(own.select("id", "fingerprint"), ["id", "fingerprint"], "left_semi").select("id", "fingerprint", "embedding", "error")
        rest = own.join(kept.select("id"), "id", "left_anti").withColumn("text", F.coalesce("text", F.lit("")))
        made, new = inferred(rest, self.log.read("cache", state), embed, how, **self.identity)
        folder = self.log.write(kept.unionByName(made.select("id", "fingerprint", "embedding", "error")), "staged")
        rows = self.log.read("staged", Version(tables={"staged": [folder]}))
        digest = F.xxhash64("id", "fingerprint").cast("decimal(20,0)"), F.xxhash64("fingerprint", "id").cast("decimal(20,0)")
        # the digest is of what was written, so a change of the items meanwhile shows later
        found = rows.agg(F.concat_ws(":", F.sum(digest[0]), F.sum(digest[1]), F.count("*")).alias("digest"), F.count("*").alias("items"), F.count("error").alias("failed")).first()
        done = state.notes["done"] | {str(part): {"folder": folder, "digest": found["digest"] if found["items"] else "0", "items": found["items"], "failed": found["failed"]}}
        tables["staged"] = [d["folder"] for d in done.values()]
        tables.setdefault("cache", []).append(self.log.write(new, "cache"))
        return self.log.commit(state, tables, **(state.notes | {"done": done})), found["items"] - kept.count()

    def commit(self, state: Version) -> Version:
        """The staged vectors as the next version, unless they are that already."""
        newest = self.vectors.at()
        run = sorted(d["folder"] for d in state.notes["done"].values())
        if newest.notes.get("run") == run:
            return newest
        rows = self.log.read("staged", state).select("id", "embedding")
        return self.vectors.commit(newest, {"vectors": [self.vectors.write(rows, "vectors")]}, identity=self.identity, run=run)
