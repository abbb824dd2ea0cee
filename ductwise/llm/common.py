"""What the corpus operators share: reading, scratch space, text normalisation, cached tokenizers."""

from __future__ import annotations

import contextlib
import math
import re
import tempfile
import uuid
from array import array
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words in every operator here: space and U+0009 to U+000D. bytes.split() uses the same six.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Small rows that go to every executor at most.
BROADCAST = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where none is set and everything runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="ductwise-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A shared folder for tables that are read only inside the block."""
    path = new_folder(spark, "scratch")
    try:
        yield path
    finally:
        remove(spark, path)


def stored(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: small rows that are read more than once. Spark removes it with the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def joined_by(left: DataFrame, right: DataFrame, key: str, n: str, hot: int = 4096) -> DataFrame:
    """left and right where `key` is equal; right has one row for each key and, as `n`, how many rows of left have it.

    Rows of left whose key has more than `hot` of them stay where they are: what right has for those keys goes to every executor, as
    long as it is at most BROADCAST rows. left is read twice then. Null keys meet nothing.
    """
    large = saved(right.where(F.col(n) > hot))
    if not 0 < large.count() <= BROADCAST:
        return left.join(right, key)
    more = [c for c in right.columns if c != key]
    marked = left.join(F.broadcast(large.select(key, F.struct(*more).alias("found_"))), key, "left")
    many = marked.where("found_ is not null").select(*left.columns, "found_.*")
    return many.unionByName(marked.where("found_ is null").drop("found_").join(right.where(F.col(n) <= hot), key).select(many.columns))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores after each as it takes for df to have no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def smallest_hashes(df: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows with the smallest hash of a column: a sample that does not depend on how rows are dealt out.

    Rows that cannot be among them by far are left out before the sort, so partitions do not send `most` rows each.
    """
    h = F.xxhash64(key).bitwiseAND(F.lit((1 << 62) - 1))
    share = min(1.0, (most + 8 * math.sqrt(most) + 8) / max(df.count(), 1))
    return df.where(h <= F.lit(int(share * (1 << 62)))).orderBy(h, key).limit(most)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def to_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "replace") if text is not None else b""


_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A plain unit ends where no letter or mark beyond ASCII and no control character but white space follows, as the library takes those into the same pre-token or piece; "'" is left out as contractions start with it.
_PUNCT, _PUNCT1 = r"!-/:-@\[-`{-~", r"!-&(-/:-@\[-`{-~"
_ENDS = r"(?![^\t-\r \x21-\x7e])"
_PLAIN = {
    "byte": rf" ?[{_LETTERS}]++{_ENDS}| ?[{_PUNCT1}][{_PUNCT}]*+{_ENDS}",
    "word": rf"[{_LETTERS}]++{_ENDS}|[{_PUNCT1}][{_PUNCT}]*+{_ENDS}",
}
_OTHER = {"byte": rf" ?[^{_BLANK}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+", "word": rf"[^{_BLANK}]+"}


class CachedTokenizer:
    """Ids of whole texts by the tokenizers library, each pre-token looked up once.

    A text is cut only where the tokenizer's own pattern cuts it, so the ids of the pieces are the ids of the text. kind is
    "byte" (byte-level pattern that keeps white space) or "word" (white space dropped, lower case). Texts with the string of a
    special token are left to the library as a whole. At most `entries`
    pieces are kept in a generation of the cache; then a new one begins, and what is still used moves to it.
    """

    def __init__(self, path: str, kind: str, entries: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special) or "(?!)", re.IGNORECASE).search
        self.kind, self.entries, self.cache, self.older = kind, entries, {}, {}
        self.find, self.plain = re.compile(f"{_PLAIN[kind]}|{_OTHER[kind]}").findall, re.compile(_PLAIN[kind]).fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = [b for b in range(256) if b not in set(printable)]
        self.chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _piece(self, unit: str) -> bytes:
        if not self.plain(unit):
            return array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        unit = unit.lower() if self.kind == "word" else unit
        mapped = unit.encode("utf-8").decode("latin-1").translate(self.chars)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if self.special(text):  # the library cuts these out first
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        units = self.find(text)
        out = list(map(self.cache.get, units))
        if None in out:
            if len(self.cache) > self.entries:
                self.cache, self.older = {}, self.cache
            cache, older = self.cache, self.older
            for i, found in enumerate(out):
                if found is None:
                    u = units[i]
                    found = cache.get(u)
                    if found is None:
                        found = older.get(u)
                        cache[u] = found = self._piece(u) if found is None else found
                    out[i] = found
        return b"".join(out)


_TOKENIZERS: dict[tuple[str, str], CachedTokenizer] = {}


def tokenizer(path: str, kind: str) -> CachedTokenizer:
    """One cache for each tokenizer in a Python worker."""
    if (path, kind) not in _TOKENIZERS:
        _TOKENIZERS[path, kind] = CachedTokenizer(path, kind)
    return _TOKENIZERS[path, kind]
