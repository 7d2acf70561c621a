"""The request protocol of the key-value service: frames, replies, and what a series of commands answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.operators.running import running

CRLF = b"\r\n"
MAX_ARGS = 1024
MAX_INT = (1 << 63) - 1
# Replies as they go over the wire.
OK, PONG, NIL = b"+OK\r\n", b"+PONG\r\n", b"$-1\r\n"
WRONG_ARGS, UNKNOWN, EMPTY = b"-ERR wrong number of arguments\r\n", b"-ERR unknown command\r\n", b"-ERR empty command\r\n"


def _count(digits: bytes) -> int | None:
    """A count as the protocol writes it: digits only, within 64 bits."""
    return n if digits.isdigit() and (n := int(digits)) <= MAX_INT else None


def parse(data: bytes) -> tuple[list[bytes], int] | None:
    """Arguments of the frame that ``data`` begins with and its length; None if it is malformed or not all there."""
    at = 0

    def line(mark: bytes) -> int | None:
        nonlocal at
        end = data.find(b"\n", at)
        if data[at : at + 1] != mark or end < at + 2 or data[end - 1 : end] != b"\r":
            return None
        n, at = _count(data[at + 1 : end - 1]), end + 1
        return n

    n = line(b"*")
    if n is None or n > MAX_ARGS:
        return None
    args = []
    for _ in range(n):
        size = line(b"$")
        if size is None or data[at + size : at + size + 2] != CRLF:
            return None
        args.append(data[at : at + size])
        at += size + 2
    return args, at


def decode(frames: DataFrame) -> DataFrame:
    """``conn, seq, pos, args, ok`` for every command in ``frames`` (``conn, seq, bytes``); frames may hold several.

    What is left over or malformed at the end of a frame is one row that is not ok. Null bytes give no row.
    """
    conn, seq = (frames.schema[c].dataType.simpleString() for c in ("conn", "seq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, data in enumerate(b.column(2).to_pylist()):
                pos = 0
                while data:
                    got = parse(data)
                    rows.append((i, pos, got[0] if got else None, got is not None))
                    data, pos = data[got[1] :] if got else b"", pos + 1
                if data == b"" and pos == 0:
                    rows.append((i, 0, None, False))
            if rows:
                at, pos, args, ok = zip(*rows, strict=True)
                take = pa.array(at, pa.int64())
                yield pa.record_batch(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(pos, pa.int32()), pa.array(args, pa.list_(pa.binary())), pa.array(ok)],
                    names=["conn", "seq", "pos", "args", "ok"],
                )

    return frames.select("conn", "seq", F.col("bytes").cast("binary").alias("bytes")).mapInArrow(run, f"conn {conn}, seq {seq}, pos int, args array<binary>, ok boolean")


def _bytes(b: bytes) -> Column:
    return F.lit(b).cast("binary")


def bulk(value: Column) -> Column:
    """A bulk string; null is the nil reply."""
    v = value.cast("binary")
    head = F.concat(F.lit("$"), F.octet_length(v).cast("string"), F.lit("\r\n")).cast("binary")
    return F.when(v.isNull(), _bytes(NIL)).otherwise(F.concat(head, v, _bytes(CRLF)))


def integer(n: Column) -> Column:
    return F.concat(F.lit(":"), n.cast("string"), F.lit("\r\n")).cast("binary")


def encode(*args: Column) -> Column:
    """A request with these arguments; null if one is null."""
    out = _bytes(f"*{len(args)}\r\n".encode())
    for a in args:
        out = F.concat(out, F.when(a.isNotNull(), bulk(a)))
    return out


def dispatch(commands: DataFrame) -> DataFrame:
    """``seq, reply`` of every command, in the order of ``seq``, from an empty store. ``commands``: ``seq, args``.

    Names of commands are taken in either case. What a command sees of a key is the last write to it that came before;
    keys named twice in one DEL count once. Args that are null or empty are an empty command.
    """
    s = lambda i: F.get("args", F.lit(i))
    c = commands.select("seq", F.coalesce("args", F.array().cast("array<binary>")).alias("args"))
    c = c.withColumn("n", F.size("args")).withColumn("cmd", F.upper(F.decode(F.coalesce(s(0), F.lit(b"")), "ISO-8859-1")))
    key_args = (
        F.when(F.col("cmd").isin("GET", "EXISTS") & (F.col("n") == 2), F.slice("args", 2, 1))
        .when((F.col("cmd") == "SET") & (F.col("n") == 3), F.slice("args", 2, 1))
        .when((F.col("cmd") == "DEL") & (F.col("n") >= 2), F.array_distinct(F.expr("slice(args, 2, n - 1)")))
    )
    use = c.select("seq", "cmd", F.explode(key_args).alias("k"), F.when(F.col("cmd") == "SET", s(2)).alias("v"))
    # Hex keeps keys that are no valid text apart.
    use = use.withColumn("key", F.hex("k"))
    wrote = F.when(F.col("cmd").isin("SET", "DEL"), F.struct("seq", "cmd", "v"))
    before = running(use, ["key"], "seq", wrote, "w", F.max)
    seen = before.groupBy("seq").agg(F.count_if(F.coalesce(F.col("w.cmd") == "SET", F.lit(False))).alias("hits"), F.max(F.when(F.col("w.cmd") == "SET", F.col("w.v"))).alias("value"))
    hits = F.coalesce("hits", F.lit(0).cast("long"))
    name, n = F.col("cmd"), F.col("n")
    reply = (
        F.when(n == 0, _bytes(EMPTY))
        .when(name == "GET", F.when(n != 2, _bytes(WRONG_ARGS)).when(hits > 0, bulk(F.col("value"))).otherwise(_bytes(NIL)))
        .when(name == "SET", F.when(n != 3, _bytes(WRONG_ARGS)).otherwise(_bytes(OK)))
        .when(name == "DEL", F.when(n < 2, _bytes(WRONG_ARGS)).otherwise(integer(hits)))
        .when(name == "EXISTS", F.when(n != 2, _bytes(WRONG_ARGS)).otherwise(integer(hits)))
        .when(name == "PING", F.when(n > 1, bulk(s(1))).otherwise(_bytes(PONG)))
        .when(name == "ECHO", F.when(n < 2, _bytes(NIL)).otherwise(bulk(s(1))))
        .when(name == "QUIT", _bytes(OK))
        .otherwise(_bytes(UNKNOWN))
    )
    return c.join(seen, "seq", "left").select("seq", reply.alias("reply"))
