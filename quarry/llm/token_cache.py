"""Token counts through a cache keyed by the digests of content and tokenizer version."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import packed, small_batches, write_stage

SPACE = "▁"
#: Counts by chunk that a worker remembers until all are forgotten, and characters of a text split at a time.
REMEMBERED, SPLIT = 1_000_000, 1_000_000
#: The file of a tokenizer goes to every worker.
MAX_FILE = 64 << 20
_CHUNK, _CUT = re.compile(" *[^ ]+| +"), re.compile("(?<=[^ ]) ")


@dataclass(frozen=True)
class Tokenizer:
    """The file of a tokenizer, read on the driver. version is the digest of library, its version and file."""

    kind: str
    data: bytes
    version: str
    #: Whether the model reads texts as they are, U+2581 as a space, and no piece reaches beyond a space.
    by_chunk: bool

    @staticmethod
    def load(path: str) -> Tokenizer:
        """A SentencePiece .model or a tokenizers .json."""
        with open(path, "rb") as f:
            data = f.read(MAX_FILE + 1)
        if len(data) > MAX_FILE:
            raise ValueError(f"a tokenizer of more than {MAX_FILE} bytes")
        if path.endswith(".json"):
            import tokenizers as library
        elif path.endswith(".model"):
            import sentencepiece as library
        else:
            raise ValueError("a tokenizer is a .json or a .model")
        version = hashlib.sha256(b"\0".join([library.__name__.encode(), library.__version__.encode(), data])).hexdigest()
        by_chunk = library.__name__ == "sentencepiece" and _splits_at_spaces(library.SentencePieceProcessor(model_proto=data))
        return Tokenizer(library.__name__, data, version, by_chunk)

    def normalised(self, text: Column) -> Column:
        """What the count depends on: null is the empty text; U+2581 is a space to a model that says so."""
        text = F.coalesce(text, F.lit(""))
        return F.replace(text, F.lit(SPACE), F.lit(" ")) if self.by_chunk else text

    def counter(self) -> Callable[[list[str]], list[int]]:
        """The library's counts of whole texts, without begin, end or added special tokens."""
        if self.kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=self.data)
            if self.by_chunk:
                return ChunkCounts(model)
            return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        import tokenizers

        whole = tokenizers.Tokenizer.from_str(self.data.decode())
        whole.no_truncation()
        whole.no_padding()
        return lambda texts: [len(x.ids) for x in whole.encode_batch(texts, add_special_tokens=False)]


def _splits_at_spaces(model) -> bool:
    probe = f"a  B1 {SPACE}éﬁ\n c "
    as_is = model.normalize(probe) == (" " + probe).replace(" ", SPACE) and any(map(model.is_byte, range(model.get_piece_size())))
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return as_is and not any(a != SPACE and b == SPACE for p in pieces for a, b in zip(p, p[1:], strict=False))


class ChunkCounts:
    """Counts of whole texts as sums over their chunks: spaces and what follows them up to the next space.
    No piece reaches from one chunk into another, so the library counts each distinct chunk once."""

    def __init__(self, model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        # a lone space at the end is one more token; its chunk without the space that begins it is empty
        self.known = {"": len(self.model.encode("a ")) - len(self.model.encode("a"))}

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks without their first space, which the model puts before whatever it reads."""
        if "  " in text or text[:1] == " " or text[-1:] in ("", " "):
            return [c[1:] for c in _CHUNK.findall(" " + text)]
        return text.split(" ")

    def parts(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text of any length, in parts that end before a space."""
        start = 0
        while cut := len(text) - start > SPLIT and _CUT.search(text, start + SPLIT):
            yield self.chunks(text[start : cut.start()])
            start = cut.end()
        if text:
            yield self.chunks(text[start:])

    def count(self, parts: list[list[str]]) -> list[int]:
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        if len(new) + len(self.known) > REMEMBERED:
            self.forget()
            new = list(set(chain.from_iterable(parts)).difference(self.known))
        self.known.update(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        return [sum(map(self.known.__getitem__, p)) for p in parts]

    def __call__(self, texts: list[str]) -> list[int]:
        out, short = [0] * len(texts), []
        for i, text in enumerate(texts):
            if len(text) > SPLIT:
                out[i] = sum(self.count([p])[0] for p in self.parts(text))
            elif text:
                short.append(i)
        for i, n in zip(short, self.count([self.chunks(texts[i]) for i in short]), strict=True):
            out[i] = n
        return out


_COUNTERS: dict[str, Callable] = {}


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each digest of a task once."""
        tokenizer = shared.value
        if tokenizer.version not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[tokenizer.version] = tokenizer.counter()
        seen: set[bytes] = set()
        for batch in batches:
            rows = {d: i for i, d in enumerate(batch["digest"].to_pylist()) if d not in seen}
            seen.update(rows)
            texts = batch["content"].take(pa.array(list(rows.values()), pa.int64())).to_pylist()
            counts = _COUNTERS[tokenizer.version](texts)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a tokenizer version; empty if there are none. Runs that
    went on side by side may have stored the same digest, so each is given once."""
    schema = "digest binary, n_tokens long"
    path = f"{cache.rstrip('/')}/tokenizer={version}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str, limit: int = 4096, key: str = "doc_id") -> DataFrame:
    """docs without text, with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    The SHA-256 of each normalised text is looked up in the cache (a folder that driver and executors
    share) under the tokenizer's version. Of each digest that is not there one row is encoded, that of
    the smallest key (where whole rows repeat, one in each task that has them), and its count is appended to the
    cache: a text is encoded once, however many keys or runs have it, and another tokenizer or another version of it has counts of its own. Texts go to the encoder only; what is
    looked up and kept is digests. A run that fails stores nothing; the next one encodes what is not stored.

    A null text counts as an empty one: no bytes, no tokens. Repeated rows and null keys give a row each. An
    empty table gives an empty result. Other columns pass through; those that bear an added column's
    name are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    content = tokenizer.normalised(F.col("text"))
    digest = F.unhex(F.sha2(content, 256))
    rows, unpacked = packed(docs, F.col(key).alias("own_key"), digest.alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), without={"text", "n_bytes", "n_tokens", "over_limit"})
    rows = write_stage(rows, "digests")
    lacking = rows.groupBy("digest").agg(F.min("own_key").alias("own_key"))
    lacking = write_stage(lacking.join(read_cache(spark, cache, tokenizer.version).select("digest"), "digest", "left_anti").withColumnsRenamed({"digest": "lacking", "own_key": "of_key"}), "misses")
    texts = docs.select(F.col(key).alias("own_key"), digest.alias("digest"), content.alias("content"))
    texts = texts.join(lacking, (F.col("digest") == F.col("lacking")) & F.col("own_key").eqNullSafe(F.col("of_key"))).select("digest", "content")
    counts = texts.mapInArrow(_counted(spark.sparkContext.broadcast(tokenizer)), "digest binary, n_tokens long")  # one file of MAX_FILE at most
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts.write.mode("append").parquet(f"{cache.rstrip('/')}/tokenizer={tokenizer.version}")
    told = read_cache(spark, cache, tokenizer.version).join(rows.select("digest").distinct(), "digest", "left_semi")
    # written, so that both sides of the join are plain shuffles, which Spark splits where a text has many rows
    done = rows.join(write_stage(told, "counts"), "digest", "left")
    return done.select(*unpacked, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
