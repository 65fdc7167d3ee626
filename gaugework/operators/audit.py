"""Tamper-evident logs: canonical JSON, sealing, parallel verification, replay, blobs."""

from __future__ import annotations

import hashlib
import json
import os
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks

#: Our own domain tag, hashed in front of every entry.
TAG = "gaugework.audit.v1|"
MOST_TAGS, MOST_TAG_BYTES, MOST_DETAIL = 32, 256, 4096


def canonical(value, path: str = "$") -> str:
    """JSON with keys in UTF-8 order, no spaces, and no floats (ValueError with the path)."""
    if isinstance(value, float):
        raise ValueError(f"a float at {path}")
    if isinstance(value, dict):
        parts = sorted(value.items(), key=lambda kv: kv[0].encode())
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical(v, f"{path}.{k}") for k, v in parts) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(v, f"{path}[{i}]") for i, v in enumerate(value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def seal(bases: list[dict], model_hash: str, first: int = 0, head: str = "") -> list[dict]:
    """Links entries: the first to the model's hash, the others to the entry before. One writer, in order.

    ``first`` and ``head`` go on with a chain of that many entries whose last has that hash.
    """
    if not model_hash.strip("0"):
        raise ValueError("the model's hash is zero")
    out, parent = [], head or model_hash
    for seq, base in enumerate(bases, first):
        text = canonical(base | {"seq": seq})
        digest = hashlib.sha256((TAG + text + parent).encode()).hexdigest()
        out.append({"idx": seq, "seq": seq, "type": "genesis" if seq == 0 else "chained", "base": text, "parent_hash": parent, "entry_hash": digest})
        parent = digest
    return out


def entry_hash(base, parent):
    return F.sha2(F.concat(F.lit(TAG), base, parent), 256)


def seal_frame(rows: DataFrame, model_hash: str) -> DataFrame:
    """Seals a frame (idx, base) of one chain, in order of idx, within one task: a hash chain cannot be split."""

    def run(batches):
        import pandas as pd

        parent = model_hash
        for b in batches:
            out = []
            for idx, base in zip(b["idx"], b["base"]):
                digest = hashlib.sha256((TAG + base + parent).encode()).hexdigest()
                out.append((idx, idx, "genesis" if idx == 0 else "chained", base, parent, digest))
                parent = digest
            yield pd.DataFrame(out, columns=["idx", "seq", "type", "base", "parent_hash", "entry_hash"])

    ordered = rows.select("idx", "base").repartition(1).sortWithinPartitions("idx")
    return ordered.mapInPandas(run, "idx long, seq long, type string, base string, parent_hash string, entry_hash string")


def verify(chain: DataFrame, model_hash: str) -> DataFrame:
    """(idx, finding) of a chain (idx, seq, type, base, parent_hash, entry_hash).

    Every row's hash is worked out by itself, so all cores take part; the links need only the row before.
    """
    links = chain.select("idx", "seq", "entry_hash")  # short rows for the ordered step
    before = ranks.with_previous(links, "idx", {"entry_hash": "prev", "seq": "prev_seq"}, chain.count()).select("idx", "first", "prev", "prev_seq")
    d = chain.join(before, "idx")
    tests = [
        ((F.col("first") & (F.col("type") != "genesis")), "missing_genesis"), (~F.col("first") & (F.col("type") == "genesis"), "duplicate_genesis"),
        (F.col("first") & (F.col("type") == "genesis") & (F.col("parent_hash") != model_hash), "genesis_hash"),
        (~F.col("first") & (F.col("parent_hash") != F.col("prev")), "parent_mismatch"), (F.col("entry_hash") != entry_hash(F.col("base"), F.col("parent_hash")), "entry_hash"),
        (~F.col("first") & (F.col("seq") != F.col("prev_seq") + 1), "seq_gap"), (F.try_parse_json("base").isNull(), "encoding"),
    ]
    found = F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in tests]), lambda x: x.isNotNull())
    own = d.select("idx", F.explode(found).alias("finding"))
    empty = chain.agg(F.count(F.lit(1)).alias("c")).where("c = 0").select(F.lit(0).cast("long").alias("idx"), F.lit("missing_genesis").alias("finding"))
    return own.unionByName(empty)


def replay(lines: DataFrame) -> DataFrame:
    """The head of a chain from its lines (idx, line): last readable entry; a broken last line is put up with, another is not."""
    d = lines.withColumn("v", F.try_parse_json("line"))
    g = d.agg(
        F.max("idx").alias("last"), F.max(F.when(F.col("v").isNull(), F.col("idx"))).alias("bad_last"), F.min(F.when(F.col("v").isNull(), F.col("idx"))).alias("bad_first"),
        F.max_by(F.get_json_object("line", "$.entry_hash"), F.when(F.col("v").isNotNull(), F.col("idx"))).alias("entry_hash"),
        F.max(F.when(F.col("v").isNotNull(), F.col("idx"))).alias("idx"),
    )
    status = F.when(F.col("bad_first").isNull(), "ok").when((F.col("bad_first") == F.col("last")), "truncated").otherwise("corrupt")
    return g.select("idx", "entry_hash", status.alias("status"))


def check_events(events: DataFrame) -> DataFrame:
    """Adds status to events (tags map, detail): too_many_tags, tag_too_long, tag_not_ascii; long details are promoted to blobs."""
    keys, values = F.map_keys("tags"), F.map_values("tags")
    status = (
        F.when(F.size(keys) > MOST_TAGS, "too_many_tags")
        .when(F.exists(values, lambda v: F.octet_length(v) > MOST_TAG_BYTES), "tag_too_long")
        .when(F.exists(keys, lambda k: F.octet_length(k) != F.length(k)), "tag_not_ascii")
        .otherwise("ok")
    )
    return events.withColumn("status", status).withColumn("blob", F.when(F.octet_length("detail") > MOST_DETAIL, F.sha2("detail", 256)))


def blobs(contents: DataFrame) -> DataFrame:
    """(sha, bytes): contents by their hash, each once."""
    return contents.select(F.sha2("content", 256).alias("sha"), F.octet_length("content").cast("long").alias("bytes")).distinct()


def unreferenced(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """Blobs (sha) that no chain refers to."""
    return stored.join(referenced, "sha", "left_anti")


def blob_counts(stored: DataFrame, referenced: DataFrame) -> DataFrame:
    """(scanned, referenced, deleted): blobs at hand, different blobs that chains refer to, and blobs to delete."""
    a, b = stored.select("sha").distinct().withColumn("here", F.lit(1)), referenced.select("sha").distinct().withColumn("wanted", F.lit(1))
    return a.join(b, "sha", "full").agg(F.count("here").alias("scanned"), F.count("wanted").alias("referenced"), F.count_if(F.col("wanted").isNull()).alias("deleted"))


def append_chain(path: str, bases: list[dict], model_hash: str) -> str:
    """Seals entries and appends them to a chain's file of JSON lines; returns the new head.

    One writer: the file is locked, read to its last line, appended to and flushed to disk before the lock goes. A broken last
    line is cut off; a file whose entries do not link up is refused.
    """
    import fcntl

    with open(path, "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        f.seek(0)
        head, count, end = model_hash, 0, 0
        for line in f:
            try:
                entry = json.loads(line)
            except ValueError:
                if f.read(1):
                    raise ValueError(f"{path}: line {count + 1} is broken") from None
                break
            if entry["parent_hash"] != head or entry["seq"] != count or entry["entry_hash"] != hashlib.sha256((TAG + entry["base"] + head).encode()).hexdigest():
                raise ValueError(f"{path}: entry {count} does not follow from the one before")
            head, count, end = entry["entry_hash"], count + 1, end + len(line)
        f.truncate(end)
        f.seek(end)
        for entry in seal(bases, model_hash, count, head):
            f.write(json.dumps(entry, ensure_ascii=False).encode() + b"\n")
            head = entry["entry_hash"]
        f.flush()
        os.fsync(f.fileno())
    return head


@contextmanager
def gate():
    """Hands out ``resolve``; leaving without having called it is an error."""
    done = []
    yield lambda: done.append(True)
    if not done:
        raise RuntimeError("an audited action was left unresolved")


class Signer:
    """What a signer of chain heads offers; keys and formats are outside this library."""

    def sign(self, digest: bytes) -> bytes:
        raise NotImplementedError

    def verify(self, digest: bytes, signature: bytes) -> bool:
        raise NotImplementedError
