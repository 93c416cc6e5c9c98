"""Registered queries for prompts, chats, training sets and encoder inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corefkit.operators import encode as E
from corefkit.operators import prompts as P
from corefkit.operators.joins import ensure_columns
from corefkit.plans import fixtures as fx
from corefkit.plans.oracle_ctes import oracle
from corefkit.plans.oracle_ctes import words as d_words
from corefkit.registry import register
from corefkit.session import shared_dir


def lit_sql(s: str) -> str:
    """A SQL string literal with newlines as chr(10)."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


def cat(*parts: str) -> str:
    return "(" + " || ".join(parts) + ")"


def _mark_sql(sentence: str, s: str, e: str) -> str:
    w = d_words(sentence)
    return (f"array_to_string(list_transform({w}, lambda x, k: (CASE WHEN k - 1 = {s} THEN '*' ELSE '' END) || x "
            f"|| (CASE WHEN k - 1 = {e} THEN '*' ELSE '' END)), ' ')")


PM_CTE = f"""pm AS (SELECT * FROM (SELECT pair_id, label, e1_trigger, e2_trigger,
        {_mark_sql('sentence1', 'e1_trigger_start', 'e1_trigger_end')} marked1,
        {_mark_sql('sentence2', 'e2_trigger_start', 'e2_trigger_end')} marked2 FROM pairs)
    WHERE marked1 IS NOT NULL AND marked2 IS NOT NULL AND e1_trigger IS NOT NULL AND e2_trigger IS NOT NULL)"""


def user_prompt_sql(kind: str) -> str:
    nl = "chr(10)"
    gap = [nl] if kind == "api" else []
    parts = [lit_sql(P.TASK_LINE), *gap,
             lit_sql(P.FIRST_SENTENCE), "marked1", nl, lit_sql(P.FIRST_WORD), "e1_trigger", lit_sql("*\n"),
             lit_sql(P.SECOND_SENTENCE), "marked2", nl, lit_sql(P.SECOND_WORD), "e2_trigger", lit_sql("*\n"), *gap,
             lit_sql(P.QUESTION), "e1_trigger", lit_sql(P.QUESTION_AND), "e2_trigger", lit_sql(P.QUESTION_END)]
    if kind == "sft":
        parts.append(lit_sql(P.ANSWER_SUFFIX))
    elif kind == "reason":
        parts.append(lit_sql(P.FORMAT_SUFFIX))
    return cat(*parts)


LABEL_TEXT_SQL = "(CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END)"
SYSTEM_SQL = lit_sql(P.DEFAULT_SYSTEM)


def turn_sql(role: str, content: str) -> str:
    return cat(lit_sql(P.IM_START + role + "\n"), content, lit_sql(P.IM_END + "\n"))


def long_sql(turns: list[tuple[str, str]], src: str = "pm", extra: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT pair_id{extra}, CAST({i} AS INT) turn, '{role}' AS role, {content} AS content FROM {src}"
        for i, (role, content) in enumerate(turns))


def _long(df, keys=("pair_id",)):
    return P.explode_chat(df, list(keys))


# ---------------------------------------------------------------- M1 - M5, P10, P11

_SFT_TURNS = [("system", SYSTEM_SQL), ("user", user_prompt_sql("sft")), ("assistant", LABEL_TEXT_SQL)]


@register("sft_messages", oracle(long_sql(_SFT_TURNS), PM_CTE), "M1", "S11", "UD1")
def q_sft_messages(spark, sf_dir):
    return _long(P.sft_messages(fx.pairs(spark, sf_dir)))


@register("grpo_messages", oracle(
    long_sql([("system", SYSTEM_SQL), ("user", user_prompt_sql("reason"))]), PM_CTE), "M2")
def q_grpo_messages(spark, sf_dir):
    return _long(P.grpo_messages(fx.pairs(spark, sf_dir)))


_PMR_CTE = f"""pmr AS (SELECT * FROM (SELECT pair_id, label, e1_trigger, e2_trigger, reasoning_content,
        {_mark_sql('sentence1', 'e1_trigger_start', 'e1_trigger_end')} marked1,
        {_mark_sql('sentence2', 'e2_trigger_start', 'e2_trigger_end')} marked2 FROM answered)
    WHERE marked1 IS NOT NULL AND marked2 IS NOT NULL AND e1_trigger IS NOT NULL AND e2_trigger IS NOT NULL
      AND reasoning_content IS NOT NULL)"""
_REASON_ASSISTANT = cat(lit_sql("<reasoning>\n"), "reasoning_content", lit_sql("\n</reasoning>\n<answer>\n"),
                        LABEL_TEXT_SQL, lit_sql("\n<answer>"))
_REASON_TURNS = [("system", SYSTEM_SQL), ("user", user_prompt_sql("reason")), ("assistant", _REASON_ASSISTANT)]


@register("reason_messages", oracle(long_sql(_REASON_TURNS, "pmr"), _PMR_CTE), "M3")
def q_reason_messages(spark, sf_dir):
    a = fx.answered(spark, sf_dir).drop("model_response")
    return _long(P.reason_messages(a))


@register("api_messages", oracle(long_sql([("user", user_prompt_sql("api"))]), PM_CTE), "M4")
def q_api_messages(spark, sf_dir):
    return _long(P.api_messages(fx.pairs(spark, sf_dir)))


_TEXT_A_SQL = cat(lit_sql(P.ENCODER_FIRST), "marked1", lit_sql(P.ENCODER_TRIGGER), "e1_trigger", "'*'")
_TEXT_B_SQL = cat(lit_sql(P.ENCODER_SECOND), "marked2", lit_sql(P.ENCODER_TRIGGER), "e2_trigger", "'*'")


@register("encoder_pair_text", oracle(f"SELECT pair_id, {_TEXT_A_SQL} text_a, {_TEXT_B_SQL} text_b FROM pm", PM_CTE),
          "M5")
def q_encoder_pair_text(spark, sf_dir):
    return P.encoder_text(fx.pairs(spark, sf_dir)).select("pair_id", "text_a", "text_b")


@register("label_text", oracle(f"SELECT pair_id, label, {LABEL_TEXT_SQL} label_text FROM pairs"), "P10")
def q_label_text(spark, sf_dir):
    return fx.pairs(spark, sf_dir).select("pair_id", "label", P.label_text().alias("label_text"))


@register("inference_prompt", oracle(long_sql(_SFT_TURNS[:2]), PM_CTE), "P11")
def q_inference_prompt(spark, sf_dir):
    m = P.sft_messages(fx.pairs(spark, sf_dir))
    return _long(m.withColumn("messages", P.inference_prompt()))


# ---------------------------------------------------------------- M8, M9, M12, M13

_SFT_TEXT_SQL = cat(*[turn_sql(r, c) for r, c in _SFT_TURNS])
_INFER_TEXT_SQL = cat(*[turn_sql(r, c) for r, c in _SFT_TURNS[:2]], lit_sql(P.ASSISTANT_PROMPT))


@register("render_chat", oracle(f"SELECT pair_id, {_SFT_TEXT_SQL} text FROM pm", PM_CTE), "M8")
def q_render_chat(spark, sf_dir):
    m = P.sft_messages(fx.pairs(spark, sf_dir))
    return m.select("pair_id", P.render_chat().alias("text"))


@register("render_inference_chat", oracle(f"SELECT pair_id, {_INFER_TEXT_SQL} prompt FROM pm", PM_CTE), "M9")
def q_render_inference_chat(spark, sf_dir):
    m = P.sft_messages(fx.pairs(spark, sf_dir))
    return m.select("pair_id", P.render_inference_chat().alias("prompt"))


_MARKER = lit_sql(P.ASSISTANT_PROMPT)


@register("completion_split", oracle(
    f"""SELECT pair_id, CASE WHEN contains(text, {_MARKER}) THEN left(text, length(text) - length(cp)) ELSE text END prompt_part,
            CASE WHEN contains(text, {_MARKER}) THEN cp ELSE '' END completion_part, contains(text, {_MARKER}) has_marker
        FROM (SELECT pair_id, text, string_split(text, {_MARKER})[-1] cp
              FROM (SELECT pair_id, {_SFT_TEXT_SQL} text FROM pm))""", PM_CTE), "M12")
def q_completion_split(spark, sf_dir):
    m = P.sft_messages(fx.pairs(spark, sf_dir)).select("pair_id", P.render_chat().alias("text"))
    return m.select("pair_id", P.completion_split("text").alias("s")).select("pair_id", "s.*")


@register("length_budget", oracle(
    f"""SELECT pair_id, CAST(len({d_words('text')}) AS INT) n_tokens, len({d_words('text')}) <= 256 prompt_fits,
            array_to_string({d_words('text')}[1:64], ' ') head_64
        FROM (SELECT pair_id, {_INFER_TEXT_SQL} text FROM pm)""", PM_CTE), "M13")
def q_length_budget(spark, sf_dir):
    m = P.sft_messages(fx.pairs(spark, sf_dir)).select("pair_id", P.render_inference_chat().alias("text"))
    return m.select("pair_id", E.budget("text", 256, 64).alias("b")).select(
        "pair_id", F.col("b.n_tokens").alias("n_tokens"), F.col("b.fits").alias("prompt_fits"),
        F.col("b.head").alias("head_64"))


# ---------------------------------------------------------------- M10, M11, IO11, IO12

_SPLIT_PM_CTE = f"""spm AS (SELECT * FROM (SELECT pair_id, label, split, e1_trigger, e2_trigger,
        {_mark_sql('sentence1', 'e1_trigger_start', 'e1_trigger_end')} marked1,
        {_mark_sql('sentence2', 'e2_trigger_start', 'e2_trigger_end')} marked2 FROM splits)
    WHERE marked1 IS NOT NULL AND marked2 IS NOT NULL AND e1_trigger IS NOT NULL AND e2_trigger IS NOT NULL)"""


@register("sft_dataset", oracle(f"SELECT split AS dataset, pair_id, {_SFT_TEXT_SQL} text FROM spm", _SPLIT_PM_CTE),
          "M10", "IO11")
def q_sft_dataset(spark, sf_dir):
    s = fx.splits(spark, sf_dir)
    parts = [s.where(F.col("split") == n).drop("split", "event_id_1", "event_id_2") for n in ("train", "dev", "test")]
    sets = P.sft_datasets(*parts)
    out = None
    for name, d in sets.items():
        d = d.select(F.lit(name).alias("dataset"), "pair_id", "text")
        out = d if out is None else out.unionByName(d)
    # IO11: export as JSON lines (one folder per set) and read back.
    path = shared_dir(spark, "sft_dataset", unique=True)
    out.write.partitionBy("dataset").mode("overwrite").json(path)
    return spark.read.schema("pair_id bigint, text string, dataset string").json(path) \
        .select("dataset", "pair_id", "text")


@register("reason_sft_dataset", oracle(
    f"SELECT pair_id, {cat(*[turn_sql(r, c) for r, c in _REASON_TURNS])} text FROM pmr", _PMR_CTE), "M10", "M3")
def q_reason_sft_dataset(spark, sf_dir):
    a = fx.answered(spark, sf_dir).drop("model_response")
    return P.sft_datasets(a, names=["reason"])["reason"].select("pair_id", "text")


@register("grpo_dataset", oracle(
    long_sql([("system", SYSTEM_SQL), ("user", user_prompt_sql("reason"))], extra=f", {LABEL_TEXT_SQL} answer"),
    PM_CTE), "M11", "IO12")
def q_grpo_dataset(spark, sf_dir):
    g = P.grpo_dataset(fx.pairs(spark, sf_dir)).select("pair_id", "prompt", "answer")
    # IO12: the {prompt, answer} set written as Parquet and read back.
    path = shared_dir(spark, "grpo_dataset", unique=True)
    g.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    return P.explode_chat(back, ["pair_id", "answer"], "prompt")


# ---------------------------------------------------------------- M6, M7

def _encode_sql(max_len: int) -> str:
    b = max_len - 3
    ids = (lambda t: f"list_transform({d_words(t)}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) "
                     f"% {E.VOCAB_SIZE - E.N_SPECIAL} + {E.N_SPECIAL} AS INT))")
    return f"""SELECT pair_id, split, label, list_resize(seq, {max_len}, 0) input_ids,
            list_transform(range(0, {max_len}), lambda i: CASE WHEN i < len(seq) THEN 1 ELSE 0 END) attention_mask
        FROM (SELECT pair_id, split, label,
                list_concat([1], a[1:k1], [2], b[1:k2], [2]) seq
              FROM (SELECT *, CASE WHEN len(a) + len(b) <= {b} THEN len(a)
                                   WHEN len(a) <= len(b) THEN least(len(a), {b // 2})
                                   ELSE {b} - least(len(b), {b // 2}) END k1,
                              CASE WHEN len(a) + len(b) <= {b} THEN len(b)
                                   WHEN len(a) <= len(b) THEN {b} - least(len(a), {b // 2})
                                   ELSE least(len(b), {b // 2}) END k2
                    FROM (SELECT pair_id, split, label, {ids(_TEXT_A_SQL)} a, {ids(_TEXT_B_SQL)} b FROM spm)))"""


def _encode(spark, sf_dir, max_len):
    s = fx.splits(spark, sf_dir)
    t = P.encoder_text(s)
    return E.encode_pairs(t, max_len=max_len).select(
        "pair_id", "split", "label", "input_ids", "attention_mask")


@register("encode_pairs", oracle(_encode_sql(E.MAX_LEN), _SPLIT_PM_CTE), "M6", "M7")
def q_encode_pairs(spark, sf_dir):
    return _encode(spark, sf_dir, E.MAX_LEN)


@register("encode_pairs_truncated", oracle(_encode_sql(48), _SPLIT_PM_CTE), "M6")
def q_encode_pairs_truncated(spark, sf_dir):
    return _encode(spark, sf_dir, 48)


@register("encode_pairs_subword", None, "M6", "M7")
def q_encode_pairs_subword(spark, sf_dir):
    """Encoder inputs by a public sub-word vocabulary, plugged in as the tokenizer (no SQL: held against the library in tests)."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenize = E.subword_tokenizer(f.read())
    t = P.encoder_text(fx.splits(spark, sf_dir))
    return E.encode_with(t, tokenize).select("pair_id", "split", "label", "input_ids", "attention_mask")


@register("ensure_response_columns", oracle(
    "SELECT pair_id, label, CAST(NULL AS VARCHAR) model_response, CAST(NULL AS VARCHAR) reasoning_content FROM pairs"),
    "P9")
def q_ensure_response_columns(spark, sf_dir):
    return ensure_columns(fx.pairs(spark, sf_dir).select("pair_id", "label"))
