"""Streams: event replay in slices, rolling context, a restorer that waits for split placeholders, session maps with expiry."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T
from ..operators import masking
from ..registry import query, table

#: Fixed value: characters of one replayed piece.
PIECE = 180


def replayed(turns: DataFrame, needs_review: Column) -> DataFrame:
    """(conv_id, turn, piece, event, data): the events of a conversation in order, an outline first, each turn's start, pieces and end, a review where needed, completion last."""
    first = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.bool_or(needs_review).alias("review"))
    edge = lambda turn, event, data: F.struct(turn.cast("long").alias("turn"), F.lit(0).cast("long").alias("piece"), F.lit(event).alias("event"), data.alias("data"))
    ends = F.array_compact(F.array(edge(F.col("low") - 1, "outline_ready", F.col("n").cast("string")), F.when(F.col("review"), edge(F.col("high") + 1, "review_required", F.lit(""))), edge(F.col("high") + 2, "complete", F.lit(""))))
    own = first.select("conv_id", F.inline(ends))
    slices = T.slices(F.coalesce("text", F.lit("")), PIECE)
    pieces = F.transform(slices, lambda x, i: F.struct((i + 1).cast("long").alias("piece"), F.lit("section_chunk").alias("event"), x.alias("data")))
    one = lambda n, event: F.array(F.struct(n.cast("long").alias("piece"), F.lit(event).alias("event"), F.coalesce("role", F.lit("")).alias("data")))
    inner = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.inline(F.concat(one(F.lit(0), "section_start"), pieces, one(F.size(slices) + 1, "section_done"))))
    return own.unionByName(inner)


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, CAST(ceil(length(text) / 180.0) AS BIGINT) AS k FROM conversations), g AS (SELECT conv_id, count(*) AS n, min(turn) AS low, max(turn) AS high, bool_or(length(text) > 2000) AS review FROM t GROUP BY 1)
    SELECT conv_id, low - 1 AS turn, 0 AS piece, 'outline_ready' AS event, n::VARCHAR AS data FROM g UNION ALL SELECT conv_id, high + 1, 0, 'review_required', '' FROM g WHERE review UNION ALL SELECT conv_id, high + 2, 0, 'complete', '' FROM g
    UNION ALL SELECT conv_id, turn, 0, 'section_start', role FROM t UNION ALL SELECT conv_id, turn, k + 1, 'section_done', role FROM t UNION ALL SELECT conv_id, turn, i + 1, 'section_chunk', substring(text, i * 180 + 1, 180) FROM (SELECT conv_id, turn, text, unnest(range(0, k)) AS i FROM t)"""
)
def event_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each conversation in order, turns in pieces of fixed length."""
    return replayed(table(spark, sf_dir, "conversations"), F.length("text") > 2000)


def preceding_context(turns: DataFrame, topic_limit: int, suffix: str) -> DataFrame:
    """(conv_id, turn, context, topics) of turns (conv_id, turn, text, topic): the whole texts of all prior turns, a line each, and the topics they covered.

    Null or empty texts and topics are left out; of more topics than ``topic_limit`` the first ones stay, followed by ``suffix``.
    """
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda c: F.collect_list(F.nullif(F.col(c), F.lit(""))).over(before)
    found = turns.select("conv_id", "turn", F.concat_ws("\n", prior("text")).alias("context"), prior("topic").alias("topics"))
    named = F.concat_ws("、", F.slice("topics", 1, topic_limit))
    return found.withColumn("topics", F.concat(named, F.when(F.size("topics") > topic_limit, F.lit(suffix)).otherwise(F.lit(""))))


@query(
    """WITH c AS (SELECT conv_id, turn, nullif(text, '') AS t, nullif(role, '') AS role FROM conversations), w AS (SELECT conv_id, turn, list(t) OVER p AS prior, list(role) OVER p AS topics FROM c WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT conv_id, turn, list_filter(coalesce(prior, []), lambda x: x IS NOT NULL) AS prior, list_filter(coalesce(topics, []), lambda x: x IS NOT NULL) AS topics FROM w)
    SELECT conv_id, turn, sha256(array_to_string(prior, chr(10))) AS context_sha256, coalesce(length(array_to_string(prior, chr(10))), 0)::INT AS context_chars, array_to_string(list_slice(topics, 1, 4), '、') || CASE WHEN len(topics) > 4 THEN ' …' ELSE '' END AS topics FROM f"""
)
def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all turns before each turn said, and the first topics that they covered."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.col("role").alias("topic"))
    found = preceding_context(turns, 4, " …")
    return found.select("conv_id", "turn", F.sha2("context", 256).alias("context_sha256"), F.length("context").alias("context_chars"), "topics")


def restored_stream(pieces: DataFrame, mappings: DataFrame) -> DataFrame:
    """A stream of text pieces (session_id, seq, text) with placeholders restored from (session_id, mapping).

    What follows the last unmatched ``[`` waits in the session's state for the next piece; ``None`` as text ends a session and
    hands the rest on.
    """
    joined = pieces.join(mappings, "session_id", "left")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, text, mapping in zip(rows["seq"], rows["text"], rows["mapping"]):
            mapping = dict(mapping) if mapping is not None else {}
            done = waiting + (text or "")
            cut = done.rfind("[") if text is not None else -1
            waiting = ""
            if cut >= 0 and "]" not in done[cut:]:
                done, waiting = done[:cut], done[cut:]
            if done:
                out.append((key[0], seq, masking.restore(done, mapping)))
        state.update((waiting,))
        yield pd.DataFrame(out, columns=["session_id", "seq", "text"])

    return joined.groupBy("session_id").applyInPandasWithState(run, "session_id long, seq long, text string", "waiting string", "append", GroupStateTimeout.NoTimeout)


def token(entity: str, n: int) -> str:
    """A number, or letters for companies."""
    out = ""
    while entity == "COMPANY" and n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out or str(n)


def allocated_stream(found: DataFrame, minutes_to_live: int) -> DataFrame:
    """Placeholders for a stream of detected values (session_id, entity, value), with numbers that last while the session does.

    A session that is not used for so many minutes is forgotten.
    """
    columns = ["session_id", "entity", "value", "placeholder"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = dict(zip(state.get[0], state.get[1])) if state.exists else {}
        used = Counter(k.partition("\n")[0] for k in known)
        out = []
        for batch in batches:
            for entity, value in zip(batch["entity"], batch["value"]):
                name = f"{entity}\n{value}"
                if name not in known:
                    used[entity] += 1
                    known[name] = f"[{masking.ENTITIES[entity][0]}_{token(entity, used[entity])}]"
                out.append((key[0], entity, value, known[name]))
        state.update((list(known), list(known.values())))
        state.setTimeoutDuration(minutes_to_live * 60_000)
        yield pd.DataFrame(out, columns=columns)

    return found.groupBy("session_id").applyInPandasWithState(run, "session_id long, entity string, value string, placeholder string", "names array<string>, placeholders array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)
