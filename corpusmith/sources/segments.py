"""A lexical index in immutable segments, under a manifest that is replaced by compare-and-rename.

A segment is what one writer added: its chunks (part, ord, chunk_id, dl, games), their postings in blocks by ranges of
terms, and document frequencies. Nothing written is ever changed. Drops are tombstones: the places of the dropped chunks
and what their terms lose. The manifest names the live segments and tombstones with their numbers of chunks and tokens; a
writer prepares files of its own and then puts manifest v + 1 in place, which fails if another writer was first, who then
begins anew over the newer state. Readers keep the manifest that they opened. A writer that dies leaves files that no
manifest names; ``vacuum`` removes them.

Statistics are sums over segments less the tombstones, so a search ranks as over an index rebuilt from the live chunks.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SetupError
from ..functions import text as T
from ..operators import blockmax, lexical
from ..scratch import materialise
from .files import hadoop

#: Segments of one size tier that are merged into one, and how often a writer begins anew.
FANOUT, ATTEMPTS = 4, 8
#: Ranges of terms (by hash) in which a segment's postings lie; a search reads the asked ones.
RANGES = 64
#: Parts of a segment whose blocks of a range of terms lie in one file.
GROUP = 32
#: Blocks that are taken apart at once when segments merge; of 128 postings at most, so a message has 65,536 rows.
OPENED = 512


@dataclass
class Segment:
    id: str
    chunks: int
    tokens: int
    parts: int
    dead: list[str] = field(default_factory=list)
    dead_chunks: int = 0
    dead_tokens: int = 0

    @property
    def live(self) -> int:
        return self.chunks - self.dead_chunks


class Conflict(Exception):
    """Another writer put a newer manifest in place first."""


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``path`` with ``text`` in one step that fails (False) if it is there: written beside it, then linked (local
    files) or renamed without overwriting (Hadoop's file systems)."""
    (target, system), side = hadoop(spark, path), f"{path}.{uuid.uuid4().hex[:8]}"
    aside, _ = hadoop(spark, side)
    out = system.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    local = target.toUri().getScheme() in (None, "file") and system.getUri().getScheme() == "file"
    try:
        if local:
            os.link(aside.toUri().getPath(), target.toUri().getPath())
            return True
        options = spark._jvm.org.apache.hadoop.fs.Options.Rename
        one = spark._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        one[0] = options.NONE
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, one)
        return True
    except FileExistsError:
        return False
    except Exception:  # the gateway's form of FileAlreadyExistsException
        if system.exists(target):
            return False
        raise
    finally:
        system.delete(aside, False)


class SegmentedIndex:
    """``chunks`` given to ``add`` have chunk_id and text, and may have games (facets). ``key`` is chunk_id's type."""

    def __init__(self, spark: SparkSession, path: str, key: str = "string", stemmed: bool = False, part_tokens: int = blockmax.PART_TOKENS):
        self.spark, self.path, self.key, self.stemmed = spark, path.rstrip("/"), key, stemmed
        self.parts_for = lambda tokens: blockmax.parts_for(tokens, part_tokens, spark.sparkContext.defaultParallelism)

    # -- manifest

    def manifest(self) -> tuple[int, list[Segment]]:
        """The newest version and its segments; 0 and none where nothing was ever added."""
        place, system = hadoop(self.spark, f"{self.path}/manifest")
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        versions = [int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()]
        if not versions:
            return 0, []
        source = system.open(hadoop(self.spark, f"{self.path}/manifest/{max(versions):09d}.json")[0])
        text = bytes(source.readAllBytes()).decode()
        source.close()
        return max(versions), [Segment(**s) for s in json.loads(text)["segments"]]

    def _commit(self, version: int, segments: list[Segment]) -> None:
        text = json.dumps({"version": version + 1, "segments": [asdict(s) for s in segments]})
        if not put_new(self.spark, f"{self.path}/manifest/{version + 1:09d}.json", text):
            raise Conflict

    def _again(self, work: Callable[[int, list[Segment]], object]) -> object:
        for _ in range(ATTEMPTS):
            try:
                return work(*self.manifest())
            except Conflict:
                continue
        raise SetupError(f"{self.path} was changed by others {ATTEMPTS} times; give up")

    # -- tables

    def _read(self, name: str, ids: Iterable[str], ddl: str) -> DataFrame:
        """A table of several segments (or tombstones) with the column ``segment``, which is a folder of each."""
        paths = [f"{self.path}/{name}/segment={i}" for i in ids]
        if not paths:
            return self.spark.createDataFrame([], f"{ddl}, segment string")
        return self.spark.read.schema(f"{ddl}, segment string").option("basePath", f"{self.path}/{name}").parquet(*paths)

    def chunks(self, segments: list[Segment] | None = None) -> DataFrame:
        """segment, part, ord, chunk_id, dl, games of the live chunks."""
        segments = self.manifest()[1] if segments is None else segments
        rows = self._read("chunks", [s.id for s in segments], f"part int, ord int, chunk_id {self.key}, dl int, games array<string>")
        return rows.join(self._dead(segments).drop("dl"), ["segment", "part", "ord"], "left_anti")

    def _dead(self, segments: list[Segment]) -> DataFrame:
        rows = self._read("dead", [d for s in segments for d in s.dead], "of string, part int, ord int, dl int")
        return rows.select(F.col("of").alias("segment"), "part", "ord", "dl")

    def frequencies(self, segments: list[Segment] | None = None) -> DataFrame:
        """term, df over the live chunks."""
        segments = self.manifest()[1] if segments is None else segments
        rows = self._read("terms", [s.id for s in segments], "term string, df long").select("term", "df")
        less = self._read("less", [d for s in segments for d in s.dead], "term string, df long").select("term", (-F.col("df")).alias("df"))
        return rows.unionByName(less).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    @staticmethod
    def stats(segments: list[Segment]) -> tuple[int, float]:
        """Live chunks and their average length."""
        n = sum(s.live for s in segments)
        return n, sum(s.tokens - s.dead_tokens for s in segments) / n if n else 0.0

    # -- writers

    def _write(self, rows: DataFrame, parts: int) -> Segment:
        """A new segment of ``rows`` (chunk_id, terms, games); no manifest names it yet."""
        name = f"s{uuid.uuid4().hex[:12]}"
        rows = materialise(blockmax.numbered(rows, parts), "segment")
        rows.select("part", "ord", "chunk_id", "dl", "games").write.parquet(f"{self.path}/chunks/segment={name}")
        self._write_blocks(name, blockmax.build_blocks(rows), parts)
        n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        return Segment(name, n, tokens, parts)

    def _write_blocks(self, name: str, blocks: DataFrame, parts: int) -> None:
        # Dealt by hash: dealing by ranges would sample the blocks first, which makes all of them twice.
        groups = -(-parts // GROUP)
        ranged = blocks.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(RANGES)).cast("int"))
        ranged = ranged.repartition(RANGES * groups, "bucket", F.pmod("part", F.lit(groups))).sortWithinPartitions("bucket", "term", "part", "block")
        ranged.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/blocks/segment={name}")
        stored = self._blocks([name]).filter(~F.col("term").startswith(blockmax.MARK))
        stored.groupBy("term").agg(F.sum("n").cast("long").alias("df")).write.parquet(f"{self.path}/terms/segment={name}")

    def _blocks(self, ids: Iterable[str]) -> DataFrame:
        return self._read("blocks", ids, f"{blockmax.BLOCKS_DDL}, bucket int")

    def add(self, chunks: DataFrame) -> int:
        """Add chunks whose id is not live (of repeats within ``chunks`` one is taken, rows without an id are skipped)
        as one segment, and give their number. None to add leaves the manifest as it is."""
        games = F.coalesce(F.col("games"), F.array().cast("array<string>")) if "games" in chunks.columns else F.array().cast("array<string>")
        found = T.tokens(F.coalesce(F.col("text"), F.lit("")))
        rows = chunks.select(F.col("chunk_id").cast(self.key), (lexical.stem_all(found) if self.stemmed else found).alias("terms"), games.alias("games"))
        rows = rows.filter("chunk_id IS NOT NULL")
        if rows.groupBy("chunk_id").count().filter("count > 1").limit(1).count():  # else all terms would be sorted for nothing
            rows = rows.dropDuplicates(["chunk_id"])
        rows = materialise(rows, "terms")

        def work(version: int, segments: list[Segment]) -> int:
            new = rows.join(self.chunks(segments).select("chunk_id"), "chunk_id", "left_anti") if segments else rows
            n, tokens = new.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
            if n:
                self._commit(version, [*segments, self._write(new, self.parts_for(tokens))])
            return n

        return self._again(work)

    def drop(self, ids: DataFrame) -> int:
        """Drop the live chunks with these chunk_ids and give their number. Only parts that hold one are read: their
        blocks tell which terms lose how many chunks."""

        def work(version: int, segments: list[Segment]) -> int:
            gone = materialise(self.chunks(segments).join(ids.select(F.col("chunk_id").cast(self.key)).distinct(), "chunk_id", "left_semi").select("segment", "part", "ord", "dl"), "gone")
            per = {r["segment"]: (r["n"], r["t"]) for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("dl").alias("t")).collect()}
            if not per:
                return 0
            now = []
            for s in segments:
                if s.id in per:
                    name = f"d{uuid.uuid4().hex[:12]}"
                    own = gone.filter(F.col("segment") == s.id)
                    own.select(F.col("segment").alias("of"), "part", "ord", "dl").write.parquet(f"{self.path}/dead/segment={name}")
                    self._lost(s.id, own).write.parquet(f"{self.path}/less/segment={name}")
                    s = Segment(s.id, s.chunks, s.tokens, s.parts, [*s.dead, name], s.dead_chunks + per[s.id][0], s.dead_tokens + per[s.id][1])
                now.append(s)
            self._commit(version, [s for s in now if s.live])
            return sum(n for n, _ in per.values())

        return self._again(work)

    def _lost(self, segment: str, gone: DataFrame) -> DataFrame:
        """term, df: in how many of the chunks that go a term stands."""

        def run(blocks: pa.Table, gone: pa.Table) -> pa.Table:
            terms, lost = [pa.array([], pa.string())], [np.zeros(0, np.int64)]
            ords = gone["ord"].to_numpy()
            for frame in blocks.to_batches(max_chunksize=65_536) if len(ords) else ():  # most blocks hold one posting: no loop over them
                n = frame.column("n").to_numpy().astype(np.int64)
                of = blockmax._unpacked_all(frame.column("ords"), n) + np.repeat(frame.column("first").to_numpy(), n)
                dead = np.zeros(max(int(of.max(initial=0)), int(ords.max())) + 1, bool)
                dead[ords] = True
                hit = np.add.reduceat(dead[of], np.cumsum(n) - n, dtype=np.int64)
                at = np.flatnonzero(hit)
                terms.append(frame.column("term").take(pa.array(at)))
                lost.append(hit[at])
            return pa.table({"term": pa.chunked_array(terms, pa.string()), "df": np.concatenate(lost)})

        touched = self._blocks([segment]).filter(~F.col("term").startswith(blockmax.MARK)).select("part", "term", "first", "ords", "n")
        touched = touched.join(F.broadcast(gone.select("part").distinct()), "part", "left_semi")
        lost = touched.groupBy("part").cogroup(gone.select("part", "ord").groupBy("part")).applyInArrow(run, "term string, df long")
        return lost.groupBy("term").agg(F.sum("df").alias("df"))

    def merge(self) -> int:
        """Merge segments of one size tier (a tier holds sizes within a factor of FANOUT) where there are FANOUT of them,
        and segments that are half dead; give the number of segments that went. Their postings are taken apart to chunks
        and cut into blocks anew; texts are not read again."""

        def work(version: int, segments: list[Segment]) -> int:
            tiers: dict[int, list[Segment]] = {}
            for s in segments:
                tiers.setdefault(int(np.log(max(1, s.live)) / np.log(FANOUT)), []).append(s)
            chosen = next((t for _, t in sorted(tiers.items()) if len(t) >= FANOUT), []) or [s for s in segments if 2 * s.dead_chunks >= s.chunks][:1]
            if not chosen:
                return 0
            tokens = sum(s.tokens - s.dead_tokens for s in chosen)
            new = self._write(self._terms(chosen), self.parts_for(tokens))
            gone = {s.id for s in chosen}
            self._commit(version, [*(s for s in segments if s.id not in gone), new])
            return len(chosen)

        return self._again(work)

    def _terms(self, segments: list[Segment]) -> DataFrame:
        """chunk_id, terms, games of the live chunks, from the blocks: a term stands in ``terms`` as often as in the text."""

        def opened(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in (whole.slice(at, OPENED) for whole in frames for at in range(0, len(whole), OPENED)):
                n, first = frame.column("n").to_numpy(), frame.column("first").to_numpy()
                of = pa.array(np.repeat(np.arange(len(n)), n))
                data = {c: blockmax._unpacked_all(frame.column(c), n.astype(np.int64)) for c in ("ords", "tfs")}
                ords = (data["ords"] + np.repeat(first, n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(frame.column(c).take(of) for c in ("segment", "part", "term")), pa.array(ords), pa.array(data["tfs"].astype(np.int32))], schema=schema)

        schema = pa.schema([("segment", pa.string()), ("part", pa.int32()), ("term", pa.string()), ("ord", pa.int32()), ("tf", pa.int32())])
        blocks = self._blocks([s.id for s in segments]).filter(~F.col("term").startswith(blockmax.MARK)).select("segment", "part", "term", "n", "first", "ords", "tfs")
        each = blocks.mapInArrow(opened, "segment string, part int, term string, ord int, tf int")
        per = each.groupBy("segment", "part", "ord").agg(F.flatten(F.collect_list(F.expr("array_repeat(term, tf)"))).alias("terms"))
        rows = self.chunks(segments).join(per, ["segment", "part", "ord"], "left")  # an empty text has no posting
        return rows.select("chunk_id", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), "games")

    def vacuum(self) -> int:
        """Remove the tables that the newest manifest does not name, and give their number. Not to be called while others
        write or read older manifests."""
        _, segments = self.manifest()
        named = {s.id for s in segments} | {d for s in segments for d in s.dead}
        n = 0
        for name in ("chunks", "blocks", "terms", "dead", "less"):
            place, system = hadoop(self.spark, f"{self.path}/{name}")
            for status in system.listStatus(place) if system.exists(place) else []:
                if status.getPath().getName().removeprefix("segment=") not in named:
                    system.delete(status.getPath(), True)
                    n += 1
        return n

    # -- search

    def _packs(self, questions: DataFrame, segments: list[Segment], qid: str, text_col: str, facet: str | None) -> tuple[DataFrame, DataFrame, float, int]:
        """The packs of weighted questions, the (term, pack) that they ask for, the average length, the number of packs."""
        total, average = self.stats(segments)
        asked = lexical.query_terms(questions, qid, text_col, self.stemmed).withColumnRenamed("qid", "_q")
        weighted = asked.join(self.frequencies(segments), "term")
        weighted = weighted.select("_q", F.struct("term", (F.col("qtf") * lexical.idf(F.lit(total), F.col("df"))).alias("weight")).alias("t")).groupBy("_q").agg(F.collect_list("t").alias("terms"))
        rows = questions.select(F.col(qid).alias("qid"), (F.col(facet).cast("string") if facet else F.lit(None).cast("string")).alias("facet")).dropDuplicates(["qid"])
        rows = rows.join(weighted, F.col("qid") == F.col("_q")).drop("_q")
        n_packs = max(1, -(-questions.count() // blockmax.PACK))
        rows = materialise(rows.withColumn("pack", F.pmod(F.xxhash64("qid"), F.lit(n_packs)).cast("int")), "questions")
        asked = rows.select(F.explode("terms.term").alias("term"), "pack")
        asked = asked.unionByName(rows.select(F.explode(F.array(F.lit(blockmax.LENGTHS), F.concat(F.lit(blockmax.FACET), "facet"))).alias("term"), "pack"))
        packs = rows.groupBy("pack").agg(F.collect_list(F.struct("qid", "facet", "terms")).alias("questions"))
        return packs, asked.filter("term IS NOT NULL").distinct(), average, n_packs

    def answers(self, questions: DataFrame, n: int, qid: str = "qid", text_col: str = "question", facet: str | None = None, segments: list[Segment] | None = None) -> DataFrame:
        """What the parts answer (see ``blockmax.answer_parts``), before the best over all parts are taken."""
        segments = self.manifest()[1] if segments is None else segments
        packs, asked, average, n_packs = self._packs(questions, segments, qid, text_col, facet)
        asked = materialise(asked, "asked")
        small = asked.count() <= lexical.BROADCAST_TERMS
        blocks = self._blocks([s.id for s in segments])
        if small:
            used = [r[0] for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(RANGES))).distinct().collect()]
            blocks = blocks.filter(F.col("bucket").isin(used))
        blocks = blocks.drop("bucket").join(F.broadcast(asked) if small else asked, "term")
        every = F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))).alias("pack")
        if any(s.dead for s in segments):
            packed = F.udf(lambda x: np.array(x, "<u4").tobytes(), "binary", useArrow=True)
            none, zero = F.lit(b""), F.lit(0)
            dead = self._dead(segments).groupBy("segment", "part").agg(F.collect_list("ord").alias("o"))
            dead = dead.select("segment", "part", F.lit(blockmax.DEAD).alias("term"), zero.alias("block"), F.size("o").alias("n"), zero.alias("first"), zero.alias("last"), packed("o").alias("ords"), none.alias("tfs"), none.alias("runs"), none.alias("tops"), zero.cast("long").alias("facets"), every)
            blocks = blocks.unionByName(dead)
        parts = self.spark.createDataFrame([(s.id, s.parts) for s in segments], "segment string, parts int")
        parts = parts.select("segment", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("segment", "part", every)
        return blockmax.answer_parts(blocks, parts.join(packs, "pack"), n, average)

    def search(self, questions: DataFrame, n: int = 60, qid: str = "qid", text_col: str = "question", facet: str | None = None) -> DataFrame:
        """qid, chunk_id, score, rank of the n best live chunks of each question; with ``facet``, a column of the
        questions, only chunks that list its value in games (null: all). Statistics are the whole index's. A question
        without tokens finds nothing; ties, at nine decimals, go to the smaller chunk_id."""
        _, segments = self.manifest()
        found = materialise(self.answers(questions, n, qid, text_col, facet, segments), "found").filter("ord >= 0").drop("opened", "scored")
        rows = found.join(self.chunks(segments).select("segment", "part", "ord", "chunk_id"), ["segment", "part", "ord"])
        return lexical.top(rows.select("qid", "chunk_id", "score"), n)
