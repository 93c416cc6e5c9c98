"""Registered queries for text, span, parser, reward and vector functions.

Text functions run over whole ``documents`` texts; span, parser and
reward functions over the derived pair and response tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.functions import parse as N
from corefkit.functions import rewards as R
from corefkit.functions.spans import extract_span, mark_span, pair_length
from corefkit.functions.text import hash_int, let, strip, words
from corefkit.functions.vectors import IGNORE_INDEX, argmax, drop_ignored, shifted_argmax, softmax
from corefkit.operators.prompts import label_text
from corefkit.plans import fixtures as fx
from corefkit.plans.oracle_ctes import WS, oracle
from corefkit.plans.oracle_ctes import strip as d_strip
from corefkit.plans.oracle_ctes import words as d_words
from corefkit.registry import register

# ---------------------------------------------------------------- S01 / S02


@register("word_tokens", oracle(
    f"""SELECT doc_id, CAST(len({d_words('text')}) AS INT) n_words, {d_words('text')}[-1] last_word,
               {d_words('text')}[1] first_word FROM documents"""), "S01")
def q_word_tokens(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", words("text").alias("w"))
    # get() gives NULL beyond the array; element_at() fails there in ANSI mode, and a blank text has no words
    return d.select("doc_id", F.size("w").alias("n_words"), F.get("w", F.size("w") - 1).alias("last_word"),
                    F.get("w", 0).alias("first_word"))


@register("strip_text", oracle(
    f"""SELECT doc_id, md5({d_strip('text')}) stripped_md5, CAST(length({d_strip('text')}) AS INT) stripped_len
        FROM documents"""), "S02")
def q_strip_text(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", strip("text").alias("s"))
    return d.select("doc_id", F.md5("s").alias("stripped_md5"), F.length("s").alias("stripped_len"))


# ---------------------------------------------------------------- P1 - P3

# Spans moved off the fixture triggers so out-of-bounds, negative and
# end-before-start cases all occur.
_S1 = "(e1_trigger_start - CAST(pair_id % 5 AS INT) + 1)"
_E1 = "(e1_trigger_end + CAST(pair_id % 7 AS INT) - 3)"


def _spans(df):
    return df.withColumns({
        "s": (F.col("e1_trigger_start") - (F.col("pair_id") % 5).cast("int") + 1).cast("int"),
        "e": (F.col("e1_trigger_end") + (F.col("pair_id") % 7).cast("int") - 3).cast("int"),
    })


_SPAN_CTE = f"""sp AS (SELECT pair_id, sentence1, CAST({_S1} AS INT) s, CAST({_E1} AS INT) e,
    {d_words('sentence1')} w FROM pairs)"""


@register("extract_trigger", oracle(
    """SELECT pair_id, s, e, CASE WHEN s >= 0 AND e < len(w) THEN array_to_string(
            list_filter(w, lambda x, i: i > s AND i <= (CASE WHEN e < -1 THEN greatest(0, len(w) + e + 1) ELSE e + 1 END)),
            ' ') END trigger FROM sp""", _SPAN_CTE), "P1", "S12", "S10")
def q_extract_trigger(spark, sf_dir):
    p = _spans(fx.pairs(spark, sf_dir))
    return p.select("pair_id", "s", "e", extract_span("sentence1", "s", "e").alias("trigger"))


@register("pair_length", oracle(
    f"SELECT pair_id, CAST(len({d_words('sentence1')}) + len({d_words('sentence2')}) AS INT) length FROM pairs"),
    "P2")
def q_pair_length(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select("pair_id", pair_length("sentence1", "sentence2").alias("length"))


_MARK_CTE = """mk AS (SELECT pair_id, s, e, w, CASE WHEN s < 0 THEN s + len(w) ELSE s END se,
    CASE WHEN e < 0 THEN e + len(w) ELSE e END ee FROM sp)"""


@register("mark_triggers", oracle(
    """SELECT pair_id, s, e, CASE WHEN se >= 0 AND se < len(w) AND ee >= 0 AND ee < len(w) THEN array_to_string(
            list_transform(w, lambda x, k: concat(CASE WHEN k - 1 = se THEN '*' ELSE '' END, x,
                                                 CASE WHEN k - 1 = ee THEN '*' ELSE '' END)), ' ') END marked
       FROM mk""", _SPAN_CTE, _MARK_CTE), "P3", "S13")
def q_mark_triggers(spark, sf_dir):
    p = _spans(fx.pairs(spark, sf_dir))
    return p.select("pair_id", "s", "e", mark_span("sentence1", "s", "e").alias("marked"))


# ---------------------------------------------------------------- N1 - N7


def _yes_no(x: str) -> str:
    return f"(CASE WHEN contains(lower({x}), 'yes') THEN 1 WHEN contains(lower({x}), 'no') THEN 0 END)"


@register("answer_after_marker", oracle(
    "SELECT pair_id, " + d_strip("string_split(completion, 'Answer:')[-1]") + " answer FROM responses"),
    "N1", "S06", "S02")
def q_answer_after_marker(spark, sf_dir):
    r = fx.responses(spark, sf_dir)
    return r.select("pair_id", N.answer_after_marker("completion").alias("answer"))


@register("parse_yes_no", oracle(f"SELECT pair_id, {_yes_no('completion')} pred FROM responses"), "N2", "S03", "S04")
def q_parse_yes_no(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("pair_id", N.yes_no("completion").alias("pred"))


@register("parse_yes_else_no", oracle(
    "SELECT pair_id, CAST(contains(lower(completion), 'yes') AS INT) pred FROM responses"), "N3")
def q_parse_yes_else_no(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("pair_id", N.yes_else_no("completion").alias("pred"))


@register("parse_tagged_answer", oracle(
    f"""SELECT pair_id, CASE WHEN contains(completion, '<answer>')
            THEN {_yes_no("split_part(completion, '<answer>', 2)")} END pred FROM responses"""), "N4")
def q_parse_tagged_answer(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("pair_id", N.tagged_answer("completion").alias("pred"))


@register("extract_xml_answer", oracle(
    f"""SELECT pair_id, {d_strip("split_part(string_split(completion, '<answer>')[-1], '</answer>', 1)")} answer
        FROM responses"""), "N5")
def q_extract_xml_answer(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("pair_id", N.xml_answer("completion").alias("answer"))


@register("parse_after_think", oracle(
    f"""SELECT pair_id, CASE WHEN contains(t, '</think>') THEN {_yes_no(d_strip("string_split(t, '</think>')[-1]"))} END pred
        FROM (SELECT pair_id, replace(completion, '</reasoning>', '</think>') t FROM responses)"""), "N6")
def q_parse_after_think(spark, sf_dir):
    r = fx.responses(spark, sf_dir).select("pair_id", F.replace("completion", F.lit("</reasoning>"),
                                                                F.lit("</think>")).alias("t"))
    return r.select("pair_id", N.after_think("t").alias("pred"))


def _token_rows(spark, sf_dir):
    """Completion words with ids; the first half is masked with -100 (prompt part)."""
    r = fx.responses(spark, sf_dir).where(F.col("completion").isNotNull())
    def tag(tokens):
        half = F.floor(F.size(tokens) / 2)
        ids = F.transform(tokens, lambda t, i: F.when(i < half, F.lit(IGNORE_INDEX))
                          .otherwise((hash_int(t) % 30000).cast("int")))
        return F.struct(tokens.alias("tokens"), ids.alias("ids"))

    # words are split once per row and shared by both arrays
    return r.select("pair_id", let(words("completion"), tag).alias("t")).select("pair_id", "t.tokens", "t.ids")


_TOKEN_CTE = f"""tk AS (SELECT pair_id, tokens, list_transform(tokens, lambda t, i: CASE WHEN i - 1 < floor(len(tokens) / 2)
        THEN -100 ELSE CAST(CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 30000 AS INT) END) ids
    FROM (SELECT pair_id, {d_words('completion')} tokens FROM responses WHERE completion IS NOT NULL))"""


@register("drop_ignored_tokens", oracle(
    "SELECT pair_id, list_filter(ids, lambda x: x <> -100) kept_ids FROM tk", _TOKEN_CTE), "S17")
def q_drop_ignored_tokens(spark, sf_dir):
    t = _token_rows(spark, sf_dir)
    return t.select("pair_id", drop_ignored("ids").alias("kept_ids"))


@register("label_from_text", oracle(
    f"""SELECT pair_id, CAST(len(kept) AS INT) n_labelled,
            CAST(list_contains({d_words("lower(array_to_string(kept, ' '))")}, 'yes') AS INT) label
        FROM (SELECT pair_id, list_filter(tokens, lambda t, i: ids[i] <> -100) kept FROM tk) WHERE len(kept) > 0""",
    _TOKEN_CTE), "N7", "S05")
def q_label_from_text(spark, sf_dir):
    t = _token_rows(spark, sf_dir)
    kept = F.transform(F.filter(F.arrays_zip("tokens", "ids"), lambda z: z["ids"] != IGNORE_INDEX),
                       lambda z: z["tokens"])
    t = t.select("pair_id", kept.alias("kept")).where(F.size("kept") > 0)
    return t.select("pair_id", F.size("kept").alias("n_labelled"),
                    N.label_from_text(F.array_join("kept", " ")).alias("label"))


# ---------------------------------------------------------------- S14 - S16, N8


@register("argmax_class", oracle(
    "SELECT vec_id, label, CAST(list_position(logits, list_max(logits)) - 1 AS INT) pred FROM logits"), "S14", "N8")
def q_argmax_class(spark, sf_dir):
    return fx.logits(spark, sf_dir).select("vec_id", "label", argmax("logits").alias("pred"))


@register("softmax_probs", oracle(
    """SELECT vec_id, list_transform(ex, lambda t: round(t / list_sum(ex), 9)) probs
       FROM (SELECT vec_id, list_transform(logits, lambda t: exp(t - list_max(logits))) ex FROM logits)"""),
    "S15", "N8")
def q_softmax_probs(spark, sf_dir):
    lg = fx.logits(spark, sf_dir)
    return lg.select("vec_id", F.transform(softmax("logits"), lambda t: F.round(t, 9)).alias("probs"))


@register("shifted_argmax", oracle(
    """SELECT vec_id, list_transform(m[1:len(m) - 1], lambda r: CAST(list_position(r, list_max(r)) - 1 AS INT)) pred_ids
       FROM (SELECT vec_id, list_transform(range(0, len(embedding) // 4),
                lambda i: CAST(embedding[i * 4 + 1:i * 4 + 4] AS DOUBLE[])) m FROM embeddings)"""), "S16")
def q_shifted_argmax(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    m = F.transform(F.sequence(F.lit(0), F.floor(F.size(emb) / 4).cast("int") - 1),
                    lambda i: F.slice(emb, i * 4 + 1, 4))
    return e.select("vec_id", shifted_argmax(m).alias("pred_ids"))


# ---------------------------------------------------------------- R1 - R5

def _occ(sub_sql: str, n: int) -> str:
    return f"CAST((length(completion) - length(replace(completion, {sub_sql}, ''))) / {n} AS INT)"


NL = "chr(10)"
_R4_CTES = [
    f"""x1 AS (SELECT pair_id, label, completion,
        CASE WHEN {_occ(f"'<reasoning>' || {NL}", 12)} = 1 THEN CAST(0 AS DOUBLE) + CAST(0.125 AS DOUBLE)
             ELSE CAST(0 AS DOUBLE) END c FROM responses)""",
    f"""x2 AS (SELECT pair_id, label, completion,
        CASE WHEN {_occ(f"{NL} || '</reasoning>' || {NL}", 14)} = 1 THEN c + CAST(0.125 AS DOUBLE) ELSE c END c FROM x1)""",
    f"""x3 AS (SELECT pair_id, label, completion,
        CASE WHEN {_occ(f"{NL} || '<answer>' || {NL}", 10)} = 1 THEN (c + CAST(0.125 AS DOUBLE))
            - length(string_split(completion, {NL} || '</answer>' || {NL})[-1]) * CAST(0.001 AS DOUBLE) ELSE c END c FROM x2)""",
    f"""x4 AS (SELECT pair_id, label, completion,
        CASE WHEN {_occ(f"{NL} || '</answer>'", 10)} = 1 THEN (c + CAST(0.125 AS DOUBLE))
            - (length(string_split(completion, {NL} || '</answer>')[-1]) - 1) * CAST(0.001 AS DOUBLE) ELSE c END c FROM x3)""",
]

_STRICT_SQL = ("CASE WHEN regexp_matches(completion, '^<reasoning>\\n[^\\n]*?\\n</reasoning>\\n<answer>\\n[^\\n]*?"
               "\\n</answer>\\n\\n?$') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
_SOFT_SQL = (f"CASE WHEN regexp_matches(completion, '^<reasoning>[^\\n]*?</reasoning>{WS}*<answer>[^\\n]*?</answer>') "
             "THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
_XMLANS_SQL = d_strip("split_part(string_split(completion, '<answer>')[-1], '</answer>', 1)")
_CORRECT_SQL = (f"CASE WHEN {_XMLANS_SQL} = (CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END) "
                "THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")


@register("reward_correctness", oracle(f"SELECT pair_id, {_CORRECT_SQL} reward FROM responses"), "R1")
def q_reward_correctness(spark, sf_dir):
    r = fx.responses(spark, sf_dir)
    return r.select("pair_id", R.correctness(F.col("completion"), label_text()).alias("reward"))


@register("reward_strict_format", oracle(f"SELECT pair_id, {_STRICT_SQL} reward FROM responses"), "R2", "S08")
def q_reward_strict_format(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("pair_id", R.strict_format("completion").alias("reward"))


@register("reward_soft_format", oracle(f"SELECT pair_id, {_SOFT_SQL} reward FROM responses"), "R3", "S08")
def q_reward_soft_format(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("pair_id", R.soft_format("completion").alias("reward"))


@register("reward_xmlcount", oracle("SELECT pair_id, c reward FROM x4", *_R4_CTES), "R4", "S07", "S09")
def q_reward_xmlcount(spark, sf_dir):
    return fx.responses(spark, sf_dir).select("pair_id", R.xml_count("completion").alias("reward"))


@register("score_completions", oracle(
    f"""SELECT pair_id, c reward_xmlcount, {_SOFT_SQL} reward_soft_format, {_STRICT_SQL} reward_strict_format,
            {_CORRECT_SQL} reward_correctness,
            c + {_SOFT_SQL} + {_STRICT_SQL} + {_CORRECT_SQL} reward FROM x4""", *_R4_CTES), "R5", "UD2")
def q_score_completions(spark, sf_dir):
    r = fx.responses(spark, sf_dir).withColumn("answer", label_text())
    s = R.score(r)
    return s.select("pair_id", "reward_xmlcount", "reward_soft_format", "reward_strict_format",
                    "reward_correctness", "reward")


_BRIEF_SQL = "CASE WHEN length(completion) <= 40 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
_HEDGE_SQL = "CASE WHEN contains(lower(completion), 'maybe') THEN CAST(-1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"


@register("score_own_rewards", oracle(
    f"""SELECT pair_id, {_CORRECT_SQL} reward_correctness, {_BRIEF_SQL} reward_brief, {_HEDGE_SQL} reward_hedge,
            {_CORRECT_SQL} + {_BRIEF_SQL} + {_HEDGE_SQL} reward FROM responses"""), "R5", "UD2")
def q_score_own_rewards(spark, sf_dir):
    """A user's own rewards beside a chosen one: short completions gain, a 'maybe' loses."""
    r = fx.responses(spark, sf_dir).withColumn("answer", label_text())
    own = [("brief", lambda comp, ans: F.when(F.length(comp) <= 40, F.lit(0.25)).otherwise(F.lit(0.0))),
           ("hedge", lambda comp, ans: F.when(F.lower(comp).contains("maybe"), F.lit(-1.0)).otherwise(F.lit(0.0)))]
    s = R.score(r, rewards={"correctness": R.DEFAULT_REWARDS["correctness"]}, extra=own)
    return s.select("pair_id", "reward_correctness", "reward_brief", "reward_hedge", "reward")
