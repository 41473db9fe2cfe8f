"""Preference formatting with DataFrame functions only.

Two conversations are a pair, one chosen and one rejected. Turn by turn from the first, as long as
both say the same, they share a prompt; it is rendered once, and each side's remaining turns are its
completion, with a mask that tells which characters are trained on (what the assistant says).

The first difference of a pair is a minimum over its turns, computed with partial sums of a plain
aggregation; equal rows fall together before any of it. Only a pair's own text meets in one row,
which is what is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def forked_pairs(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """pair_id, chosen, turn, role, text: pairs of conversations that fork, made from single ones.

    Pair k's chosen conversation is 2k. The rejected one is the same up to its last turn of the
    trained role (the last such turn number), which is replaced by the first reply of conversation
    2k + 1 (the least text of its least such number) and ends it. Where 2k has no such turn or 2k + 1
    no reply, 2k + 1 itself is the rejected one. Rows without a conversation are left out.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.floor(F.col(conv_col) / 2).cast("long").alias("pair_id"), (F.pmod(F.col(conv_col), F.lit(2)) == 0).alias("first"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    said = (F.col("role") == trained) & F.col("turn").isNotNull()
    marks = rows.groupBy("pair_id").agg(F.max(F.when(F.col("first") & said, F.col("turn"))).alias("last"), F.min(F.when(~F.col("first") & said, F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))["text"].alias("reply"))
    forks = F.col("last").isNotNull() & F.col("reply").isNotNull()
    marks = marks.select("pair_id", F.when(forks, F.col("last")).alias("last"), F.when(forks, F.col("reply")).alias("reply"))
    sides = F.when(F.col("first"), F.when(F.col("turn") < F.col("last"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).when(F.col("last").isNull(), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    both = rows.join(marks, "pair_id").select("pair_id", F.explode(sides).alias("chosen"), "turn", "role", "text")
    return both.unionByName(marks.where("last is not null").select("pair_id", F.lit(False).alias("chosen"), F.col("last").alias("turn"), F.lit(trained).alias("role"), F.col("reply").alias("text")))


def format_pairs(turns: DataFrame, *, pair_col: str = "pair_id", side_col: str = "chosen", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """pair_id, status, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    turns has a row for each turn; side_col is true for the chosen conversation. A mask has a string
    `from-to` of character positions (from included, to not) for each trained turn in a completion.
    Status: "pair"; "equal" if both say the same throughout (empty completions); "chosen only" or
    "rejected only" if the other side has no row, and then the prompt is empty and all of the
    conversation is completion. Turns go by their number, then role and text; a row that is repeated
    counts once; a null number sorts first, null roles and texts are empty. Rows without a pair id
    belong to no pair and are left out, as are sides that are null.
    """
    turns = turns.where(F.col(pair_col).isNotNull() & F.col(side_col).isNotNull())
    rows = turns.select(F.col(pair_col).cast("long").alias("pair_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(common.NULL_ID)).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(side_col).cast("boolean").alias("is_chosen"))
    said = rows.groupBy("pair_id", "turn", "role", "text").agg(F.coalesce(F.bool_or("is_chosen"), F.lit(False)).alias("in_chosen"), F.coalesce(F.bool_or(~F.col("is_chosen")), F.lit(False)).alias("in_rejected"))
    both = F.col("in_chosen") & F.col("in_rejected")
    # the prompt ends before the first turn number at which any message is on one side only
    item = F.struct("turn", "role", "text", "in_chosen", "in_rejected")
    pairs = said.groupBy("pair_id").agg(F.min(F.when(~both, F.col("turn"))).alias("fork"), F.bool_or("in_chosen").alias("any_chosen"), F.bool_or("in_rejected").alias("any_rejected"), F.array_sort(F.collect_list(item)).alias("turns"))
    shared = lambda x: F.col("fork").isNull() | (x["turn"] < F.col("fork"))
    pairs = pairs.withColumns({
        "head": F.filter("turns", shared),
        "yes": F.filter("turns", lambda x: x["in_chosen"] & ~shared(x)),
        "no": F.filter("turns", lambda x: x["in_rejected"] & ~shared(x)),
    })
    status = F.when(~F.col("any_rejected"), "chosen only").when(~F.col("any_chosen"), "rejected only").when(F.col("fork").isNull(), "equal").otherwise("pair")
    return pairs.select("pair_id", status.alias("status"), F.size("head").cast("long").alias("n_prompt_turns"), _text("head").alias("prompt"), _text("yes").alias("chosen"), _mask("yes", trained).alias("chosen_mask"), _text("no").alias("rejected"), _mask("no", trained).alias("rejected_mask"))


def _one(x: Column) -> Column:
    return F.concat(F.lit(OPEN), x["role"], F.lit("\n"), x["text"], F.lit(CLOSE))


def _text(col: str) -> Column:
    return F.array_join(F.transform(col, _one), "")


def _mask(col: str, trained: str) -> Column:
    """Positions of what the trained role says, with its closing mark and without its opening one."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, x):
        low = acc["at"] + F.length(F.concat(F.lit(OPEN), x["role"], F.lit("\n")))
        high = low + F.length(x["text"]) + (len(CLOSE) - 1)
        span = F.concat(low.cast("string"), F.lit("-"), high.cast("string"))
        return F.struct((acc["at"] + F.length(_one(x))).cast("long").alias("at"), F.when(x["role"] == trained, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.array_join(F.aggregate(col, start, step, lambda acc: acc["spans"]), ",")


def oracle() -> str:
    """DuckDB: the pairs that forked_pairs makes of the table conversations."""
    one = f"'{OPEN}' || role || chr(10) || text || '{CLOSE[:-1]}' || chr(10)"
    head = f"length('{OPEN}' || role || chr(10))"
    parts = []
    for side in ("chosen", "rejected"):
        parts.append(f"""{side}_t AS (SELECT pair_id, string_agg(one, '' ORDER BY turn, role, text) AS full_text,
          coalesce(string_agg(CASE WHEN role = 'assistant' THEN (at0 + {head}) || '-' || (at0 + {head} + length(text) + {len(CLOSE) - 1}) END, ',' ORDER BY turn, role, text), '') AS mask
          FROM (SELECT *, coalesce(sum(length(one)) OVER (PARTITION BY pair_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at0
            FROM (SELECT s.*, {one} AS one FROM said s JOIN forks USING (pair_id) WHERE in_{side} AND fork IS NOT NULL AND turn >= fork)) GROUP BY pair_id)""")
    return f"""WITH cv AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 = 0 AS first, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
      mk AS (SELECT pair_id, max(turn) FILTER (first AND role = 'assistant') AS last, arg_min(coalesce(text, ''), (turn, coalesce(text, ''))) FILTER (NOT first AND role = 'assistant' AND turn IS NOT NULL) AS reply FROM cv GROUP BY 1),
      ok AS (SELECT * FROM mk WHERE last IS NOT NULL AND reply IS NOT NULL),
      sd AS (SELECT pair_id, true AS chosen, turn, role, text FROM cv WHERE first
        UNION ALL SELECT pair_id, false, turn, role, text FROM cv JOIN ok USING (pair_id) WHERE first AND turn < last
        UNION ALL SELECT pair_id, false, last, 'assistant', reply FROM ok
        UNION ALL SELECT pair_id, false, turn, role, text FROM cv WHERE NOT first AND pair_id NOT IN (SELECT pair_id FROM ok)),
      said AS (SELECT pair_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, bool_or(chosen) AS in_chosen, bool_or(NOT chosen) AS in_rejected FROM sd GROUP BY ALL),
      forks AS (SELECT pair_id, min(turn) FILTER (NOT (in_chosen AND in_rejected)) AS fork, bool_or(in_chosen) AS c, bool_or(in_rejected) AS j FROM said GROUP BY 1),
      heads AS (SELECT pair_id, count(*) AS n, string_agg({one}, '' ORDER BY turn, role, text) AS prompt FROM said JOIN forks USING (pair_id) WHERE fork IS NULL OR turn < fork GROUP BY 1),
      {', '.join(parts)}
      SELECT pair_id, CASE WHEN NOT j THEN 'chosen only' WHEN NOT c THEN 'rejected only' WHEN fork IS NULL THEN 'equal' ELSE 'pair' END AS status, CAST(coalesce(n, 0) AS BIGINT) AS n_prompt_turns, coalesce(prompt, '') AS prompt,
        coalesce(chosen_t.full_text, '') AS chosen, coalesce(chosen_t.mask, '') AS chosen_mask, coalesce(rejected_t.full_text, '') AS rejected, coalesce(rejected_t.mask, '') AS rejected_mask
      FROM forks LEFT JOIN heads USING (pair_id) LEFT JOIN chosen_t USING (pair_id) LEFT JOIN rejected_t USING (pair_id)"""
