"""DuckDB SQL twins of the fixture views and metrics (the correctness oracle).

Written independently of the Spark code, in plain SQL over the driver's
pre-registered tables. ``sql(body, *needs, extra=...)`` assembles a WITH chain from
the shared CTEs a query needs (each shared CTE lists its own dependencies) plus
query-local CTEs, so a query pulls in only what it uses.
"""

from __future__ import annotations

from raterlab import constants as C
from raterlab.plans import fixtures as X

EMO_CSV = ",".join(C.EMOTIONS)
EMO_LIST = "[" + ", ".join(f"'{e}'" for e in C.EMOTIONS) + "]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _json_str(x: str) -> str:
    e = f"replace({x}, '\\', '\\\\')"
    e = f"replace({e}, '\"', '\\\"')"
    e = f"replace({e}, chr(10), '\\n')"
    e = f"replace({e}, chr(13), '\\r')"
    e = f"replace({e}, chr(9), '\\t')"
    return f"('\"' || {e} || '\"')"


def _py_str(x: str) -> str:
    e = f"replace({x}, '\\', '\\\\')"
    e = f"replace({e}, '''', '\\''')"
    e = f"replace({e}, chr(10), '\\n')"
    e = f"replace({e}, chr(13), '\\r')"
    e = f"replace({e}, chr(9), '\\t')"
    return f"('''' || {e} || '''')"


def _json_arr(lst: str) -> str:
    return f"('[' || array_to_string(list_transform({lst}, lambda q: {_json_str('q')}), ', ') || ']')"


def _runs_values() -> str:
    rows = []
    for n, a in enumerate(C.APPROACHES, start=1):
        keys = [(C.BASELINE_PERSONA, "a")] if a == C.BASELINE_APPROACH else [(p, X.PERSONA_RATER[p]) for p in C.PERSONAS]
        for p, r in keys:
            for s in C.SEEDS:
                rows.append(f"({_q(a)}, {n}, {_q(p)}, {_q(r)}, {s})")
    return ", ".join(rows)


def _runmap_values() -> str:
    rows = []
    for a in C.APPROACHES:
        for p in C.PERSONAS:
            stored = C.BASELINE_PERSONA if a == C.BASELINE_APPROACH else p
            rows.append(f"({_q(a)}, {_q(p)}, {_q(stored)})")
    return ", ".join(rows)


# python-literal list validation / extraction (RE2)
_PY_ITEM = r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
PY_LIST_RE = r"\s*\[\s*(?:" + _PY_ITEM + r"(?:\s*,\s*" + _PY_ITEM + r")*\s*,?)?\s*\]\s*"
PY_ITEM_SQ = r"'((?:[^'\\]|\\.)*)'"


def _py_unescape(x: str) -> str:
    e = f"replace({x}, '\\\\', chr(0))"
    e = f"replace({e}, '\\n', chr(10))"
    e = f"replace({e}, '\\r', chr(13))"
    e = f"replace({e}, '\\t', chr(9))"
    e = f"replace({e}, '\\''', '''')"
    e = f"replace({e}, chr(0), '\\')"
    return e


def py_list_parse(x: str) -> str:
    """F3 in DuckDB: NULL unless ``x`` is a Python list literal of strings."""
    return (f"CASE WHEN regexp_full_match({x}, {_q(PY_LIST_RE)}) THEN "
            f"list_transform(regexp_extract_all({x}, {_q(PY_ITEM_SQ)}, 1), lambda u: {_py_unescape('u')}) END")


CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTE[name] = (deps, body)


cte("pubs", [], """
SELECT doc_id AS id, text, lang,
       '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS date
FROM documents""")

cte("ann0", ["pubs"], """
SELECT p.id, p.text, p.lang, p.date, r.rater,
  CASE WHEN r.rater = 'a' THEN p.id % 7 ELSE (p.id + CASE WHEN p.id % 5 = 0 THEN 1 ELSE 0 END) % 7 END AS k,
  CASE WHEN r.rater = 'a' THEN p.id % 5 + 1 ELSE (p.id + p.id % 3) % 5 + 1 END AS lvl,
  list_filter(CASE WHEN r.rater = 'a'
       THEN [{'start': CAST(p.id % 7 AS INT), 'end': CAST(p.id % 7 + 11 AS INT)}]
       ELSE [{'start': CAST(p.id % 5 AS INT), 'end': CAST(p.id % 5 + 7 AS INT)},
             {'start': CAST(p.id % 5 + 20 AS INT), 'end': CAST(p.id % 5 + 25 AS INT)}] END,
       lambda s: s['end'] < length(p.text)) AS locs
FROM pubs p CROSS JOIN (VALUES ('a'), ('b')) r(rater)""")

cte("ann", ["ann0"], f"""
SELECT md5('rater_' || rater)[1:8] AS created_by, rater, id, text, lang,
  split_part('{EMO_CSV}', ',', CAST(k + 1 AS INT)) AS emotion,
  CASE WHEN k IN (1, 2, 3) THEN 'positive' ELSE 'negative' END AS emotion_class,
  CAST(lvl AS INT) AS trigger_level,
  list_transform(locs, lambda s: substring(text, s['start'] + 1, s['end'] - s['start'] + 1)) AS context,
  locs AS context_locations,
  CASE WHEN id % 4 = 0 THEN NULL ELSE 'rater ' || rater || ' note ' || CAST(id AS VARCHAR) END AS description,
  date AS created_at
FROM ann0""")

cte("personas", [], "SELECT * FROM (VALUES " + ", ".join(
    f"({_q(p)}, md5('rater_{X.PERSONA_RATER[p]}')[1:8], {_q(X.PERSONA_NARRATIVE[p])})" for p in C.PERSONAS)
    + ") t(persona, annotator, narrative)")

cte("runs", [], f"SELECT * FROM (VALUES {_runs_values()}) t(approach, approach_no, persona, rater, seed)")
cte("runmap", [], f"SELECT * FROM (VALUES {_runmap_values()}) t(approach, persona, stored)")

cte("split_head", ["pubs"], f"""
SELECT id, row_number() OVER (ORDER BY date ASC NULLS LAST, id) AS pos
FROM pubs ORDER BY date ASC NULLS LAST, id LIMIT {C.FT_TRAIN_NUM + C.FT_VAL_NUM}""")

cte("split", ["pubs", "split_head"], f"""
SELECT p.id, CASE WHEN h.pos IS NULL THEN 'evaluation' WHEN h.pos <= {C.FT_TRAIN_NUM} THEN 'ft_training'
                  ELSE 'ft_validation' END AS split_name
FROM pubs p LEFT JOIN split_head h ON p.id = h.id""")

_shift = "((a.id + r.seed + r.approach_no) % 4 = 0)"
_k = f"(list_position({EMO_LIST}, a.emotion) - 1)"
_emo = f"CASE WHEN {_shift} THEN split_part('{EMO_CSV}', ',', CAST(({_k} + 1) % 7 + 1 AS INT)) ELSE a.emotion END"
_cls = f"CASE WHEN {_shift} THEN CASE WHEN a.emotion_class = 'positive' THEN 'negative' ELSE 'positive' END ELSE a.emotion_class END"
_lvl = f"CAST(CASE WHEN {_shift} THEN a.trigger_level % 5 + 1 ELSE a.trigger_level END AS VARCHAR)"
_phr = "CASE WHEN a.lang = 'en' THEN list_transform(a.context, lambda q: upper(q)) ELSE a.context END"

cte("preds0", ["ann", "runs"], f"""
SELECT r.approach, r.persona, r.seed, a.id, a.id % 11 AS v, {_emo} AS emo, {_cls} AS cls, {_lvl} AS lvl, {_phr} AS phrases
FROM ann a JOIN runs r ON a.rater = r.rater""")

_items = "array_to_string(list_transform(phrases, lambda q: " + _json_str("q") + "), ', ')"
cte("preds", ["preds0"], f"""
SELECT approach, persona, seed, id,
  '{C.MODEL_NAME}' AS model_name, CAST({C.TEMPERATURE} AS DOUBLE) AS temperature, {C.MAX_TOKENS} AS max_tokens,
  CASE WHEN v = 0 THEN '{C.FAILED_OUTPUT_JSON}' ELSE
    '{{"emotion": ' || CASE WHEN v = 4 THEN '"happiness"' ELSE {_json_str('emo')} END
    || ', "emotion_class": ' || CASE WHEN v = 8 THEN 'null' ELSE {_json_str('cls')} END
    || ', "trigger_level": ' || CASE WHEN v = 1 THEN '"' || lvl || '"' WHEN v = 2 THEN lvl || '.7'
                                     WHEN v = 3 THEN '"' || lvl || '.7"' ELSE lvl END
    || CASE WHEN v = 9 THEN '' ELSE ', "context": ' ||
         CASE WHEN v = 5 THEN {_json_str("('[' || array_to_string(list_transform(phrases, lambda q: " + _py_str('q') + "), ', ') || ']')")}
              WHEN v = 6 THEN {_json_arr("list_append(phrases, " + _q(X.ABSENT_PHRASE) + ")")}
              WHEN v = 7 THEN '[{X.NESTED_ITEM_JSON}' || CASE WHEN len(phrases) > 0 THEN ', ' || {_items} ELSE '' END || ']'
              ELSE {_json_arr('phrases')} END END
    || ', "description": ' || {_json_str("'felt ' || emo")} || '}}' END AS output
FROM preds0""")

# ---- validation (V1–V7) -------------------------------------------------------
cte("pj", ["preds", "pubs"], """
SELECT p.approach, p.persona, p.seed, p.id, u.text,
       CASE WHEN json_valid(p.output) THEN p.output ELSE '{}' END AS j
FROM preds p LEFT JOIN pubs u ON p.id = u.id""")

_EMPTY_ITEMS = "CAST([] AS STRUCT(s VARCHAR, raw VARCHAR)[])"
cte("pc", ["pj"], f"""
SELECT *, json_type(j, '$.context') AS ctype, json_extract_string(j, '$.context') AS ctext,
       {py_list_parse("json_extract_string(j, '$.context')")} AS cparsed
FROM pj""")

cte("pi", ["pc"], f"""
SELECT *,
  CASE WHEN ctype = 'ARRAY' THEN list_transform(json_extract(j, '$.context[*]'),
            lambda x: {{'s': CASE WHEN json_type(x) = 'VARCHAR' THEN x->>'$' END, 'raw': CAST(x AS VARCHAR)}})
       WHEN ctype = 'VARCHAR' AND cparsed IS NOT NULL THEN list_transform(cparsed, lambda x: {{'s': x, 'raw': x}})
       ELSE {_EMPTY_ITEMS} END AS items,
  CASE WHEN ctype IS NULL OR ctype IN ('NULL', 'ARRAY') THEN CAST([] AS VARCHAR[])
       WHEN ctype = 'VARCHAR' THEN CASE WHEN cparsed IS NULL THEN [ctext] ELSE CAST([] AS VARCHAR[]) END
       ELSE [CAST(json_extract(j, '$.context') AS VARCHAR)] END AS pre
FROM pc""")

cte("pl", ["pi"], """
SELECT *, list_transform(items, lambda it: {'s': it.s, 'raw': it.raw,
            'pos': CASE WHEN it.s IS NULL THEN -1 ELSE instr(lower(text), lower(it.s)) - 1 END}) AS loc
FROM pi""")

_lvl_sql = """CASE json_type(j, '$.trigger_level')
    WHEN 'BIGINT' THEN TRY_CAST(json_extract_string(j, '$.trigger_level') AS INT)
    WHEN 'UBIGINT' THEN TRY_CAST(json_extract_string(j, '$.trigger_level') AS INT)
    WHEN 'DOUBLE' THEN TRY_CAST(trunc(CAST(json_extract_string(j, '$.trigger_level') AS DOUBLE)) AS INT)
    WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(json_extract_string(j, '$.trigger_level'), '\\s*[+-]?[0-9]+\\s*')
                             THEN TRY_CAST(trim(json_extract_string(j, '$.trigger_level')) AS INT) END
    WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(j, '$.trigger_level') = 'true' THEN 1 ELSE 0 END
  END"""

cte("valid", ["pl"], f"""
SELECT approach, persona, seed, id, text,
  CASE WHEN json_extract_string(j, '$.emotion') IN {tuple(C.EMOTIONS)} THEN json_extract_string(j, '$.emotion') ELSE 'corrupted' END AS emotion,
  CASE WHEN json_extract_string(j, '$.emotion_class') IN ('positive', 'negative') THEN json_extract_string(j, '$.emotion_class') ELSE 'corrupted' END AS emotion_class,
  COALESCE({_lvl_sql}, -1) AS trigger_level,
  list_transform(list_filter(loc, lambda x: x.pos >= 0), lambda x: x.s) AS context,
  list_transform(list_filter(loc, lambda x: x.pos >= 0), lambda x: {{'start': CAST(x.pos AS INT), 'end': CAST(x.pos + length(x.s) AS INT)}}) AS context_locations,
  list_concat(pre, list_transform(list_filter(loc, lambda x: x.pos < 0), lambda x: COALESCE(x.s, x.raw))) AS context_corrupted,
  json_extract_string(j, '$.description') AS description
FROM pl""")

cte("validf", ["valid"], """
SELECT *, (emotion = 'corrupted' OR emotion_class = 'corrupted' OR trigger_level = -1) AS failed FROM valid""")

cte("mapped", ["validf", "runmap"], """
SELECT v.approach, m.persona, v.seed, v.id, v.text, v.emotion, v.emotion_class, v.trigger_level, v.context,
       v.context_locations, v.context_corrupted, v.failed
FROM validf v JOIN runmap m ON v.approach = m.approach AND v.persona = m.stored""")

cte("truth", ["ann", "personas", "split"], """
SELECT p.persona, a.* FROM ann a JOIN personas p ON a.created_by = p.annotator
WHERE a.id IN (SELECT id FROM split WHERE split_name = 'evaluation')""")

cte("aligned", ["truth", "mapped"], """
SELECT p.approach, t.persona, p.seed, t.id,
  t.emotion AS t_emotion, t.emotion_class AS t_emotion_class, t.trigger_level AS t_trigger_level,
  t.context AS t_context, t.context_locations AS t_locs,
  p.emotion, p.emotion_class, p.trigger_level, p.context, p.context_locations AS p_locs, p.context_corrupted, p.failed
FROM truth t JOIN mapped p ON t.persona = p.persona AND t.id = p.id""")


def overlap_chars(a: str, b: str) -> str:
    """J12 total intersection length in DuckDB (inclusive ends)."""
    return (f"COALESCE(list_sum(list_transform({a}, lambda x: COALESCE(list_sum(list_transform("
            f"list_filter({b}, lambda y: greatest(x['start'], y['start']) <= least(x['end'], y['end'])), "
            f"lambda y: least(x['end'], y['end']) - greatest(x['start'], y['start']) + 1)), 0))), 0)")


def span_chars(a: str, extra: int = 1) -> str:
    return f"COALESCE(list_sum(list_transform({a}, lambda x: x['end'] - x['start'] + {extra})), 0)"


cte("rowq", ["aligned"], f"""
SELECT approach, persona, seed, id, t_emotion, emotion, t_emotion_class, emotion_class, t_trigger_level, trigger_level,
  CAST(failed AS INT) AS failed, len(t_context) AS t_items, len(context) AS p_items,
  len(list_distinct(list_intersect(t_context, context))) AS strict_correct,
  len(context_corrupted) AS corrupted_items,
  {span_chars('t_locs')} AS t_chars, {span_chars('p_locs')} AS p_chars,
  {overlap_chars('t_locs', 'p_locs')} AS overlap_chars
FROM aligned""")

cte("cells", ["rowq"], """
SELECT approach, persona, seed, 'emotion' AS field, t_emotion AS y, emotion AS yhat, count(*) AS n FROM rowq GROUP BY ALL
UNION ALL
SELECT approach, persona, seed, 'emotion_class', t_emotion_class, emotion_class, count(*) FROM rowq GROUP BY ALL
UNION ALL
SELECT approach, persona, seed, 'trigger_level', CAST(t_trigger_level AS VARCHAR), CAST(trigger_level AS VARCHAR), count(*)
FROM rowq GROUP BY ALL""")

cte("per_label", ["cells"], """
SELECT approach, persona, seed, field, label, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp
FROM (SELECT approach, persona, seed, field, y AS label, n AS support, 0 AS predicted, CASE WHEN y = yhat THEN n ELSE 0 END AS tp FROM cells
      UNION ALL
      SELECT approach, persona, seed, field, yhat, 0, n, 0 FROM cells) u
GROUP BY ALL""")

cte("wprf", ["per_label"], """
SELECT approach, persona, seed, field,
  sum(support * CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END) / nullif(sum(support), 0) AS precision,
  sum(tp) / nullif(sum(support), 0) AS recall,
  sum(support * CASE WHEN support + predicted > 0 THEN 2.0 * tp / (support + predicted) ELSE 0 END) / nullif(sum(support), 0) AS f1_score,
  CAST(sum(support) AS BIGINT) AS support
FROM per_label GROUP BY ALL""")

cte("totals", ["rowq"], """
SELECT approach, persona, seed, count(*) AS n_rows, sum(failed) AS failed, sum(t_items) AS t_items, sum(p_items) AS p_items,
  sum(strict_correct) AS strict_correct, sum(corrupted_items) AS corrupted_items, sum(t_chars) AS t_chars,
  sum(p_chars) AS p_chars, sum(overlap_chars) AS overlap_chars
FROM rowq GROUP BY ALL""")


def _prf_sql(correct: str, predicted: str, annotated: str, suffix: str = "f1_score") -> str:
    p = f"(CAST({correct} AS DOUBLE) / nullif(CAST({predicted} AS DOUBLE), 0))"
    r = f"(CAST({correct} AS DOUBLE) / nullif(CAST({annotated} AS DOUBLE), 0))"
    return f"{p} AS precision, {r} AS recall, 2.0 * {p} * {r} / nullif({p} + {r}, 0) AS {suffix}"


cte("spanm", ["totals"], f"""
SELECT approach, persona, seed, 'strict' AS overlap, {_prf_sql('strict_correct', 'p_items + n_rows * n_rows', 't_items')},
  CAST(strict_correct AS BIGINT) AS correct, CAST(p_items + n_rows * n_rows AS BIGINT) AS predicted, CAST(t_items AS BIGINT) AS annotated
FROM totals
UNION ALL
SELECT approach, persona, seed, 'proportional', {_prf_sql('overlap_chars', 'p_chars + n_rows * corrupted_items', 't_chars')},
  CAST(overlap_chars AS BIGINT), CAST(p_chars + n_rows * corrupted_items AS BIGINT), CAST(t_chars AS BIGINT)
FROM totals""")

cte("report", ["wprf", "spanm", "totals"], """
SELECT t.approach, t.persona, t.seed, CAST(t.failed AS DOUBLE) / t.n_rows AS failed,
""" + ",\n".join(
    [f"  max(CASE WHEN w.field = '{f}' THEN w.{m} END) AS {f}_{m}"
     for f in C.LABEL_FIELDS for m in ("precision", "recall", "f1_score")]) + """
FROM totals t JOIN wprf w USING (approach, persona, seed)
GROUP BY t.approach, t.persona, t.seed, t.failed, t.n_rows""")

cte("report_full", ["report", "spanm"], """
SELECT r.*, """ + ", ".join(
    [f"max(CASE WHEN s.overlap = '{o}' THEN s.{m} END) AS \"context_{o}_{out}\""
     for o in ("strict", "proportional") for m, out in (("precision", "precision"), ("recall", "recall"),
                                                          ("f1_score", "f1-score"))]) + """
FROM report r JOIN spanm s USING (approach, persona, seed)
GROUP BY ALL""")


def sql(body: str, *needs: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Assemble ``WITH <needed CTEs in dependency order>, <extra CTEs> <body>``;
    ``extra`` holds query-local CTEs as (name, body) pairs, in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTE[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({CTE[n][1]}\n)" for n in order] + [f"{n} AS ({b}\n)" for n, b in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


def rnd(col: str, alias: str | None = None, places: int = 6) -> str:
    return f"round(CAST({col} AS DOUBLE), {places}) AS \"{alias or col}\""
