"""DuckDB restatements of the fixtures, for oracle SQL.

An oracle is ``WITH <these CTEs> <plain SQL>``; DuckDB only evaluates
the CTEs a query references. The Spark builders are in ``fixtures.py``.
"""

from __future__ import annotations

from corefkit.functions.text import WS_DUCK

WS = WS_DUCK


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def hash_int(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


def yes_no(x: str) -> str:
    return (f"(CASE WHEN contains(lower({x}), 'yes') THEN 1 "
            f"WHEN contains(lower({x}), 'no') THEN 0 END)")


def tagged_answer(x: str) -> str:
    return f"(CASE WHEN contains({x}, '<answer>') THEN {yes_no(f'split_part({x}, {chr(39)}<answer>{chr(39)}, 2)')} END)"


def last_part(x: str, sep: str) -> str:
    return f"string_split({x}, '{sep}')[-1]"


def occurrences(x: str, sub_sql: str, sub_len: int) -> str:
    return f"CAST((length({x}) - length(replace({x}, {sub_sql}, ''))) / {sub_len} AS INT)"


_BASE = [
    f"""m0 AS (SELECT doc_id, source, lang,
                    list_filter(list_transform(string_split(text, chr(10)), lambda x: {words("x")}), lambda w: len(w) > 0) ls
             FROM documents)""",
    """m1 AS (SELECT doc_id, source, lang, len(ls) n_lines, unnest(range(len(ls))) line, unnest(ls) w FROM m0)""",
    """m2 AS (SELECT *, len(w) n, CAST((doc_id * 7 + line * 3) % len(w) AS INT) s FROM m1)""",
    """m3 AS (SELECT *, CAST(least(s + (doc_id + line) % 2, n - 1) AS INT) e FROM m2)""",
    """mentions AS (SELECT doc_id, source, lang, line, n_lines, array_to_string(w, ' ') sentence, s t_start, e t_end,
                    array_to_string(w[s + 1:e + 1], ' ') trig FROM m3)""",
    """pairs_wide AS (SELECT a.doc_id * 1000003 + a.line pair_id, a.source, a.doc_id doc1, b.doc_id doc2,
                 a.lang lang1, b.lang lang2,
                 a.sentence sentence1, a.t_start e1_trigger_start, a.t_end e1_trigger_end, a.trig e1_trigger,
                 b.sentence sentence2, b.t_start e2_trigger_start, b.t_end e2_trigger_end, b.trig e2_trigger,
                 CASE WHEN substr(lower(a.trig), 1, 1) = substr(lower(b.trig), 1, 1) THEN 1 ELSE 0 END label
          FROM mentions a JOIN mentions b
            ON b.doc_id = a.doc_id + CASE WHEN a.line = a.n_lines - 1 THEN 1 ELSE 0 END
           AND b.line = CASE WHEN a.line = a.n_lines - 1 THEN 0 ELSE a.line + 1 END)""",
    """pairs AS (SELECT pair_id, source, sentence1, e1_trigger_start, e1_trigger_end, e1_trigger,
                 sentence2, e2_trigger_start, e2_trigger_end, e2_trigger, label FROM pairs_wide)""",
    f"""r0 AS (SELECT pair_id, source, label,
              {hash_int("'r:' || CAST(pair_id AS VARCHAR)")} % 8 h,
              CASE WHEN label = 1 THEN 'Yes' ELSE 'No' END yn,
              CASE WHEN label = 1 THEN 'No' ELSE 'Yes' END ny, chr(10) nl FROM pairs)""",
    """responses_h AS (SELECT pair_id, source, label, h, CASE h
    WHEN 0 THEN concat('<reasoning>', nl, 'same scene', nl, '</reasoning>', nl, '<answer>', nl, yn, nl, '</answer>', nl)
    WHEN 1 THEN concat('<reasoning>', nl, 'two', nl, 'lines', nl, '</reasoning>', nl, '<answer>', nl, ny, nl, '</answer>', nl)
    WHEN 2 THEN concat('<reasoning>r</reasoning> <answer>', yn, '</answer>')
    WHEN 3 THEN concat('<reasoning>', nl, 'r', nl, '</reasoning>', nl, '<answer>', nl, yn, nl, '<answer>')
    WHEN 4 THEN 'I cannot tell'
    WHEN 5 THEN '<answer>maybe</answer>'
    WHEN 6 THEN concat('Answer: ', ny, nl, 'Answer: ', yn, '. </answer> tail')
    END completion FROM r0)""",
    """responses AS (SELECT pair_id, source, label, completion FROM responses_h)""",
    f"""preds AS (SELECT pair_id, source, label, {tagged_answer("completion")} pred FROM responses_h)""",
    """preds_multi AS (SELECT pair_id, lang1 label, lang2 pred FROM pairs_wide)""",
    """logits AS (SELECT vec_id, label % 2 label, CAST(embedding AS DOUBLE[]) logits FROM embeddings)""",
    """answered AS (SELECT p.*, r.completion model_response,
                 CASE WHEN r.h < 4 THEN 'reasoning ' || CAST(r.h AS VARCHAR) END reasoning_content
          FROM pairs p LEFT JOIN responses_h r USING (pair_id))""",
    """response_log AS (SELECT a.pair_id, g.attempt,
          CASE WHEN a.pair_id % 7 = 0 AND g.attempt = 1 THEN NULL
               WHEN a.pair_id % 7 = 0 AND g.attempt = 2 THEN 'draft' ELSE a.model_response END model_response,
          CASE WHEN a.pair_id % 7 = 0 AND g.attempt < 3 THEN NULL ELSE a.reasoning_content END reasoning_content,
          CASE WHEN a.pair_id % 7 = 0 AND g.attempt = 1 THEN 'timeout' END error
        FROM answered a, LATERAL (SELECT unnest(range(1, CASE WHEN a.pair_id % 7 = 0 THEN 4 ELSE 2 END)) attempt) g)""",
    f"""splits AS (SELECT CASE WHEN s = 'test' THEN CAST(doc1 AS VARCHAR) END event_id_1,
                   CASE WHEN s = 'test' THEN CAST(doc2 AS VARCHAR) END event_id_2,
                   pair_id, source, sentence1, e1_trigger_start, e1_trigger_end, e1_trigger,
                   sentence2, e2_trigger_start, e2_trigger_end, e2_trigger, label, s split
          FROM (SELECT *, CASE WHEN {hash_int("'s:' || CAST(pair_id AS VARCHAR)")} % 10 < 8 THEN 'train'
                               WHEN {hash_int("'s:' || CAST(pair_id AS VARCHAR)")} % 10 = 8 THEN 'dev'
                               ELSE 'test' END s FROM pairs_wide))""",
    """runs AS (SELECT user_id % 5 run_id, date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) step,
                round(avg(value), 6) reward, round(stddev_pop(value), 6) reward_std,
                round(avg(value) FILTER (WHERE event_type = 'click'), 6) "rewards/click_reward_func",
                round(avg(value) FILTER (WHERE event_type = 'view'), 6) "rewards/view_reward_func",
                round(avg(value) FILTER (WHERE event_type = 'error'), 6) "rewards/int_reward_func",
                count(*) completion_length
         FROM events GROUP BY 1, 2)""",
]


def oracle(body: str, *extra_ctes: str) -> str:
    """``WITH <fixture CTEs>[, extra] <body>``."""
    ctes = _BASE + list(extra_ctes)
    return "WITH " + ",\n".join(ctes) + "\n" + body
