"""DuckDB SQL for the registered queries, written apart from the Spark code."""

from __future__ import annotations

from catalog.derived import ANSWERS, FORMS, FOREIGN, LANGUAGES, LINK, OUTSIDE, SUFFIXES
from glyphloom import values as V
from glyphloom.functions.chat import system_prompt
from glyphloom.operators import conversations
from glyphloom.sources.seeds import SEEDS

_SP = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
_S, _NS, _W = f"[{_SP}]", f"[^{_SP}]", r"[\p{L}\p{N}_]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]"


def _in(items) -> str:
    return "(" + ", ".join(_q(i) for i in items) + ")"


_EMOJI = _list(V.EMOJI)


def _at(index: str) -> str:
    return f"({_EMOJI})[CAST({index} AS INTEGER) + 1]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _clean(x: str) -> str:
    for pattern, new in ((f"http{_NS}+|www\\.{_NS}+", ""), (f"@{_W}+", "@user"),
                         (f"#({_W}+)", r"\1"), (f"{_S}+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return f"trim({x}, ' ')"


def _any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {_q(w)})" for w in words) + ")"


def _case(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {default} END"


def _label(x: str) -> str:
    whens = " ".join(f"WHEN {_q(e)} THEN {n}" for n, e in V.EMOJI_BY_LABEL.items())
    return f"CASE {x} {whens} ELSE -1 END"


def _alternative(x: str) -> str:
    return _case(x, V.ALTERNATIVE, _q(V.DEFAULT_ALTERNATIVE))


def _polarity(x: str) -> str:
    return f"CASE WHEN {x} IN {_in(V.POSITIVE_EMOJI)} THEN 'positive' ELSE 'neutral_or_negative' END"


def _replaced(form: str, marks: dict[str, str]) -> str:
    x = _q(form)
    for mark, value in marks.items():
        x = f"replace({x}, {_q(mark)}, {value})"
    return x


# --- derived tables ---

LINES = """
lines AS (
  SELECT doc_id, n, line, doc_id * 100000 + n AS post_id FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           unnest(range(len(string_split(text, chr(10))))) AS n
    FROM documents))"""

_suffix = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in SUFFIXES.items())
POSTS = LINES + f""",
posts AS (
  SELECT post_id, CAST((doc_id * 7 + n) % 21 AS INTEGER) AS label,
         line || CASE (doc_id + n) % 9 WHEN 0 THEN {_q(LINK)} || post_id {_suffix} ELSE '' END AS raw
  FROM lines),
cleaned AS (SELECT post_id, label, {_clean('raw')} AS text FROM posts),
kept AS (
  SELECT post_id, label, text, {_at('label')} AS emoji FROM cleaned
  WHERE length(text) BETWEEN 10 AND 280)"""

_types = " ".join(f"WHEN {k} THEN {_q(t)}" for k, t in enumerate(V.SAMPLE_TYPES))
SAMPLES = f"""
samples AS (
  SELECT post_id AS seq, line AS text, coalesce({_at('(doc_id * 7 + n) % 21')}, '{OUTSIDE}') AS emoji,
         CASE post_id % 6 {_types} END AS type,
         CASE post_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'mixed' END
           AS true_sentiment
  FROM lines)"""

_truth = _at("CASE WHEN doc_id % 40 < 19 THEN doc_id % 40 ELSE 0 END")
PREDICTIONS = f"""
predictions AS (
  SELECT 'model' || m AS model, doc_id AS id, truth,
         CASE WHEN k = 22 THEN '{V.NO_ANSWER}' WHEN k < 6 THEN truth WHEN k < 20 THEN {_at('k')}
              ELSE '{FOREIGN}' END AS pred
  FROM (SELECT doc_id, m, {_truth} AS truth, (doc_id * (m * 2 + 3) + n_chars) % 23 AS k
        FROM documents, (SELECT unnest(range(3)) AS m)))"""

_forms = " ".join(
    f"WHEN {k} THEN {_replaced(f, {'<P>': 'p', '<A>': 'a'})}" for k, f in enumerate(FORMS)
)
RAW = f"""
raw_outputs AS (
  SELECT doc_id AS id, {_truth} AS truth, CASE doc_id % 14 {_forms} END AS raw
  FROM (SELECT doc_id, {_at('doc_id % 20')} AS p, {_at('(doc_id * 7 + 3) % 20')} AS a
        FROM documents))"""

_found = "(" + "|".join(sorted(V.EMOJI, key=len, reverse=True)) + ")"


def _parse(source: str) -> str:
    """CTEs from ``source(id, truth, raw)`` to ``parsed``."""
    def text(name: str) -> str:
        return (f"CASE WHEN doc IS NULL OR json_extract(doc, '$.{name}') IS NULL THEN '' "
                f"ELSE json_extract_string(doc, '$.{name}') END AS {name}")

    def listed(name: str) -> str:
        value = _strip(f"json_extract_string(doc, '$.{name}')")
        return (f"CASE WHEN json_type(doc, '$.{name}') = 'VARCHAR' AND {value} IN {_in(V.EMOJI)} "
                f"THEN {value} END")

    strip_think = _strip("regexp_replace(raw, '<think>.*?</think>', '', 'gs')")
    no_fence = _strip("replace(replace(answer, '```json', ''), '```', '')")
    return f"""
answered AS (SELECT id, truth, raw, {strip_think} AS answer FROM {source}),
spans AS (SELECT *, regexp_extract({no_fence}, '\\{{.*\\}}', 0, 's') AS span FROM answered),
docs AS (
  SELECT *, CASE WHEN span <> '' AND json_valid(span) THEN span END AS doc,
         regexp_extract_all(answer, '{_found}') AS found
  FROM spans),
picked AS (
  SELECT *, {listed('primary')} AS p0, {listed('alternative')} AS a0,
         CAST(json_extract(doc, '$.irony') AS VARCHAR) AS shown
  FROM docs),
parsed AS (
  SELECT id, truth, coalesce(p0, found[1], '{V.NO_ANSWER}') AS "primary",
         CASE WHEN p0 IS NULL AND len(found) > 1 THEN found[2] ELSE a0 END AS alternative,
         {text('tone')},
         coalesce(shown NOT IN ('false', 'null', '""', '[]', '{{}}')
                  AND coalesce(try_cast(shown AS DOUBLE) <> 0, true), false) AS irony,
         {text('reason')}, doc IS NOT NULL AS parse_success
  FROM picked)"""


_answer_forms = " ".join(
    f"WHEN {k} THEN " + _replaced(
        f, {"<ID50>": "CAST(doc_id % 50 AS VARCHAR)", "<ID>": "CAST(doc_id AS VARCHAR)", "<P>": "p"})
    for k, f in enumerate(ANSWERS)
)
_fields = ", ".join(
    f"json_extract_string(item, '$.{c}') AS {c}" for c in ("text", "emoji", "type", "true_sentiment")
)
ANSWERED = f"""
answers AS (
  SELECT doc_id AS batch_id, CASE doc_id % 5 {_answer_forms} END AS answer
  FROM (SELECT doc_id, {_at('doc_id % 20')} AS p FROM documents)),
bodies AS (
  SELECT batch_id, {_strip("replace(replace(answer, '```json', ''), '```', '')")} AS body
  FROM answers),
judged AS (
  SELECT batch_id, CASE WHEN json_valid(body) THEN
           CASE WHEN json_type(body) = 'ARRAY' THEN body END END AS doc
  FROM bodies),
items AS (
  SELECT batch_id, pos, json_extract(doc, '$[' || pos || ']') AS item
  FROM (SELECT batch_id, doc, unnest(range(CAST(json_array_length(doc) AS BIGINT))) AS pos
        FROM judged WHERE doc IS NOT NULL)),
answer_rows AS (SELECT batch_id, pos, {_fields} FROM items),
extra AS (
  SELECT batch_id * 10 + pos AS seq, text, emoji, type, true_sentiment FROM answer_rows)"""


def _good(source: str) -> str:
    """SELECT of the usable rows of ``source`` with defaults filled."""
    return f"""
  SELECT * REPLACE ({_strip("coalesce(text, '')")} AS text, {_strip("coalesce(emoji, '')")} AS emoji,
                    coalesce(type, 'unknown') AS type,
                    coalesce(true_sentiment, 'unknown') AS true_sentiment)
  FROM {source}
  WHERE length({_strip("coalesce(text, '')")}) >= 10
    AND {_strip("coalesce(emoji, '')")} IN {_in(V.EMOJI)}"""


def _first(source: str, order: str) -> str:
    return f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY {order}) AS rn FROM {source})
  WHERE rn = 1"""


_seed_rows = ", ".join(
    f"({n}, {', '.join(_q(x) for x in seed)})" for n, seed in enumerate(SEEDS)
)
CURATED = f"""
seeds AS (SELECT * FROM (VALUES {_seed_rows}) AS t(seq, text, emoji, type, true_sentiment)),
all_samples AS (
  SELECT 0 AS origin, * FROM seeds UNION ALL SELECT 1, * FROM samples
  UNION ALL SELECT 2, * FROM extra),
good AS ({_good('all_samples')}),
curated AS ({_first('good', 'origin, seq')})"""

_ironic = f"({_any('text', V.IRONY_WORDS)} AND {_any('text', V.NEGATIVE_WORDS)})"
_tone = (f"CASE WHEN {_ironic} THEN 'Ironic or sarcastic' WHEN {_polarity('emoji')} = 'positive' "
         "THEN 'Positive' ELSE 'Neutral_or_negative' END || ' emotional tone'")
TARGET = f"""(
  '{{"tone": "' || {_tone} || '", "irony": ' || CASE WHEN {_ironic} THEN 'true' ELSE 'false' END
  || ', "primary": ' || CAST(to_json(emoji) AS VARCHAR) || ', "alternative": "' || {_alternative('emoji')}
  || '", "reason": ' || CAST(to_json('The text conveys a ' || {_polarity('emoji')}
  || ' sentiment, best matched by ' || emoji || '.') AS VARCHAR) || '}}')"""
_SYSTEM, _OPEN_SYSTEM = (_q(system_prompt(c)) for c in (True, False))
_USER = "'Text: ' || text || chr(10) || 'Analyze and predict:'"

TOP = 2000
_TERM_CTES = f"""
words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{_W}{{2,}}') AS w FROM documents),
grams AS (
  SELECT doc_id, w, list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS t
  FROM words)"""


def _vocabulary(column: str, source: str, top: int | None = V.MAX_FEATURES) -> str:
    """The vocabulary of the ``top`` most frequent terms, or of all terms for None."""
    bound = "" if top is None else f"WHERE rank <= {top}"
    return f"""
terms AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest({column}) AS term FROM {source}) GROUP BY ALL),
ranked AS (
  SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count, count(*) AS doc_count,
         row_number() OVER (ORDER BY sum(tf) DESC, term) AS rank
  FROM terms GROUP BY term),
vocabulary AS (
  SELECT *, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (doc_count + 1)) + 1 AS idf
  FROM ranked {bound})"""


def _encoded(words: str, keys: str) -> str:
    return f"""
placed AS (
  SELECT doc_id, pos, w[pos] AS term
  FROM (SELECT doc_id, w, unnest(range(1, least(len(w), 256) + 1)) AS pos FROM {words})),
coded AS (
  SELECT doc_id, list(coalesce(rank + 1, 1) ORDER BY pos) AS ids
  FROM placed LEFT JOIN vocabulary USING (term) GROUP BY doc_id),
shaped AS (
  SELECT {keys}, len(w) AS n_tokens, coalesce(ids, []) AS ids
  FROM {words} LEFT JOIN coded USING (doc_id)),
filled AS (
  SELECT {keys}, n_tokens, array_to_string(list_concat(ids,
           [0 FOR i IN range(256 - len(ids))]), ',') AS input_ids,
         array_to_string(list_concat([1 FOR i IN range(len(ids))],
           [0 FOR i IN range(256 - len(ids))]), ',') AS attention_mask
  FROM shaped)
SELECT {keys}, n_tokens, n_tokens > 256 AS truncated, input_ids, attention_mask,
       input_ids AS labels
FROM filled"""


def _asked(system: str) -> str:
    return (f"'[[system]]' || chr(10) || {system} || chr(10) || '[[user]]' || chr(10) || {_USER}"
            " || chr(10)")


def _chat(system: str) -> str:
    answer = f"'[[assistant]]' || chr(10) || {TARGET} || chr(10)"
    return f"({_asked(system)} || CASE WHEN emoji IS NULL THEN '' ELSE {answer} END)"


def _score(pred: str = "pred", truth: str = "truth") -> str:
    whens = " ".join(
        f"WHEN {pred} = {_q(a)} AND {truth} = {_q(b)} THEN {s} "
        f"WHEN {pred} = {_q(b)} AND {truth} = {_q(a)} THEN {s}"
        for (a, b), s in V.SIMILARITY.items()
    )
    return f"CASE WHEN {pred} = {truth} THEN 100 {whens} ELSE 0 END"


CLASSES = f"""
classes AS (SELECT unnest({_EMOJI}) AS emoji),
models AS (SELECT DISTINCT model FROM rows_in),
per_class AS (
  SELECT model, emoji,
         (SELECT count(*) FROM rows_in r WHERE r.model = m.model AND pred = emoji AND truth = emoji) AS tp,
         (SELECT count(*) FROM rows_in r WHERE r.model = m.model AND pred = emoji AND truth <> emoji) AS fp,
         (SELECT count(*) FROM rows_in r WHERE r.model = m.model AND pred <> emoji AND truth = emoji) AS fn
  FROM models m, classes),
scored AS (
  SELECT *, tp + fn AS support, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0
         ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1
  FROM per_class),
f1s AS (
  SELECT model, avg(f1) AS f1_macro, sum(f1 * support) / sum(support) AS f1_weighted
  FROM scored GROUP BY model)"""

_known = lambda c: f"CASE WHEN {c} IN {_in(V.EMOJI)} THEN {c} ELSE 'other' END"
ROWS_IN = "rows_in AS (SELECT * FROM predictions)"
ANNOTATED = """
annotated AS (
  SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'sarcasm' WHEN quality = 0 THEN 'dark_humor'
         ELSE 'bittersweet' END AS type FROM labels)"""
_usable = f"alternative IS NOT NULL AND alternative NOT IN ('', '{V.NO_ANSWER}')"
_alt_score = (f"coalesce(avg({_score('alternative', 'truth')}) FILTER (WHERE {_usable}) / 100.0::DOUBLE,"
              " 0.0)")
_irony_acc = f"""
  SELECT count(*) AS n_annotated,
         avg(CASE WHEN irony = (type IN {_in(V.IRONIC_TYPES)}) THEN 1.0 ELSE 0.0 END)
           AS irony_detection_accuracy
  FROM parsed JOIN annotated USING (id)"""


def _comparison(rows_in: str) -> str:
    return f"""
WITH {LINES}, {PREDICTIONS}, {RAW}, {_parse('raw_outputs')}, {ANNOTATED},
rows_in AS ({rows_in}), {CLASSES},
basic AS (
  SELECT model, avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END) AS accuracy,
         avg({_score()}) / 100.0::DOUBLE AS semantic_score,
         avg(CASE WHEN {_polarity('pred')} = {_polarity('truth')} THEN 1.0 ELSE 0.0 END) AS sentiment_acc
  FROM rows_in GROUP BY model),
generated AS (
  SELECT 'tuned' AS model, avg(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END)
           AS json_parse_success_rate, {_alt_score} AS alternative_semantic_score
  FROM parsed),
ironies AS ({_irony_acc})
SELECT model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro,
       round(f1_weighted, 6) AS f1_weighted, round(semantic_score, 6) AS semantic_score,
       round(sentiment_acc, 6) AS sentiment_acc,
       round(json_parse_success_rate, 6) AS json_parse_success_rate,
       round(alternative_semantic_score, 6) AS alternative_semantic_score,
       CASE WHEN model = 'tuned' THEN round((SELECT irony_detection_accuracy FROM ironies), 6) END
         AS irony_detection_accuracy
FROM basic JOIN f1s USING (model) LEFT JOIN generated USING (model)"""


_ANSWERED_ROWS = "SELECT 'tuned' AS model, truth, \"primary\" AS pred FROM parsed"


def _draw(key: str) -> str:
    return f"md5('42:' || {key})"


_UNION = """
posts_in AS (
  SELECT 'post:' || post_id AS row_key, text, label, emoji, NULL AS type, NULL AS true_sentiment,
         post_id AS id
  FROM kept),
extra_in AS (
  SELECT 'extra:' || seq AS row_key, {clean} AS text, {label} AS label, emoji, type, true_sentiment
  FROM extra)""".format(clean=_clean("text"), label=_label("emoji"))


def _split_of(source: str, partition: str = "") -> str:
    over = f"OVER ({partition})"
    rank = f"row_number() OVER ({partition} ORDER BY {_draw(chr(39) + 'split:' + chr(39) + ' || row_key')})"
    return (f"SELECT *, CASE WHEN {rank} <= ceil(CAST(0.1 AS DOUBLE) * count(*) {over}) "
            f"THEN 'val' ELSE 'train' END AS split FROM {source}")


_columns = "row_key, text, label, emoji, type, true_sentiment"
_langs = " ".join(f"WHEN {_q(l)} THEN {n}" for n, l in enumerate(LANGUAGES))
_rule = " ".join([
    "CASE length(text) % 3 WHEN 0 THEN '{\"primary\": \"' || p || '\", \"alternative\": \"' || a",
    "|| '\", \"irony\": true}' WHEN 1 THEN 'I would say ' || p || ' or ' || a",
    "ELSE 'no idea' END",
])
_bins = list(enumerate(zip(V.SIMILARITY_EDGES, V.SIMILARITY_EDGES[1:])))

ORACLE: dict[str, str] = {
    "aligned_files": f"""
WITH {POSTS} SELECT row_number() OVER (ORDER BY post_id) - 1 AS post_id,
  replace(CAST(post_id AS VARCHAR) || ' ' || raw, chr(13), ' ') AS raw, label FROM posts""",
    "samples_from_files": f"""
WITH {LINES}, {SAMPLES} SELECT row_number() OVER (ORDER BY seq) - 1 AS seq,
  text, emoji, type, true_sentiment FROM samples""",
    "aligned_labels": """
        SELECT doc_id, lang, quality, toxic, d.doc_id IS NOT NULL AS in_left,
               l.doc_id IS NOT NULL AS in_right
        FROM documents d FULL OUTER JOIN labels l USING (doc_id)""",
    "label_dimension": f"""
        WITH {POSTS}
        SELECT label, emoji, {_polarity('emoji')} AS polarity, {_alternative('emoji')} AS alternative,
               (SELECT count(*) FROM posts p WHERE p.label = t.label) AS n
        FROM (SELECT CAST(unnest(range(20)) AS INTEGER) AS label, unnest({_EMOJI}) AS emoji) t""",
    "label_to_emoji": f"WITH {POSTS} SELECT post_id, label, {_at('label')} AS emoji FROM posts",
    "emoji_to_label": f"""
        WITH {LINES}, {SAMPLES} SELECT seq, emoji, {_label('emoji')} AS label FROM samples""",
    "parse_answer_batches": f"""
        WITH {ANSWERED}
        SELECT batch_id, CAST(pos AS INTEGER) AS pos, text, emoji, type, true_sentiment
        FROM answer_rows""",
    "answer_counts": f"""
        WITH {ANSWERED}
        SELECT count(*) AS answers, count(doc) AS accepted, count(*) - count(doc) AS rejected,
               (SELECT count(*) FROM answer_rows) AS samples
        FROM judged""",
    "union_widen": f"""
        WITH {POSTS}, {SAMPLES}
        SELECT post_id AS id, text, label, {_at('label')} AS emoji, NULL::VARCHAR AS type,
               NULL::VARCHAR AS true_sentiment
        FROM cleaned
        UNION ALL
        SELECT seq, text, {_label('emoji')}, emoji, type, true_sentiment FROM samples""",
    "clean_text": f"WITH {POSTS} SELECT post_id, text FROM cleaned",
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "length_filter": f"WITH {POSTS} SELECT post_id, text, length(text) AS n_chars FROM kept",
    "irony_rule": f"""
        WITH {POSTS}
        SELECT post_id, {_any('text', V.IRONY_WORDS)} AS irony_word,
               {_any('text', V.NEGATIVE_WORDS)} AS negative, {_ironic} AS irony
        FROM cleaned""",
    "training_target": f"WITH {POSTS} SELECT post_id, text, emoji, {TARGET} AS target FROM kept",
    "chat_messages": f"""
        WITH {POSTS}
        SELECT post_id, CAST(CASE WHEN emoji IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_messages,
               {_SYSTEM} AS system, {_USER} AS "user", {TARGET} AS assistant
        FROM kept""",
    "render_chat": f"""
        WITH {POSTS}
        SELECT post_id, '[[system]]' || chr(10) || {_SYSTEM} || chr(10) || '[[user]]' || chr(10)
               || {_USER} || chr(10)
               || coalesce('[[assistant]]' || chr(10) || {TARGET} || chr(10), '') AS chat
        FROM kept""",
    "render_conversations": conversations.oracle(),
    "render_turns": """
        SELECT conv_id, turn, '[[' || role || ']]' || chr(10) || text || chr(10) AS message
        FROM conversations""",
    "strip_think": f"WITH {RAW}, {_parse('raw_outputs')} SELECT id, answer FROM answered",
    "extract_json": f"WITH {RAW}, {_parse('raw_outputs')} SELECT id, span FROM spans",
    "scan_emoji": f"""
        WITH {RAW}, f AS (SELECT id, regexp_extract_all(raw, '{_found}') AS found FROM raw_outputs)
        SELECT id, len(found) AS n_found, array_to_string(found, '|') AS found FROM f""",
    "parse_output": f"""
        WITH {RAW}, {_parse('raw_outputs')}
        SELECT id, "primary", alternative, tone, irony, reason, parse_success FROM parsed""",
    "score_and_parse": f"""
        WITH ruled AS (
          SELECT doc_id AS id, NULL AS truth, {_rule} AS raw
          FROM (SELECT doc_id, text, {_at('length(text) % 20')} AS p, {_at('length(text) % 7')} AS a
                FROM documents)),
        {_parse('ruled')}
        SELECT id, "primary", alternative, tone, irony, reason, parse_success FROM parsed""",
    "predict_records": f"""
        WITH asked AS (
          SELECT doc_id, lang, text AS body, {_asked(_SYSTEM)} || '[[assistant]]' || chr(10) AS prompt
          FROM documents),
        ruled AS (
          SELECT doc_id AS id, NULL AS truth, {_rule} AS raw
          FROM (SELECT doc_id, prompt AS text, {_at('length(prompt) % 20')} AS p,
                       {_at('length(prompt) % 7')} AS a FROM asked)),
        {_parse('ruled')}
        SELECT id, lang, body AS text, "primary", alternative, tone, irony, reason, parse_success
        FROM parsed JOIN asked ON id = doc_id""",
    "quality_filter": f"WITH {LINES}, {SAMPLES} {_good('samples')}",
    "dedupe_first": f"""
        WITH {LINES}, {SAMPLES}, good AS ({_good('samples')}) {_first('good', 'seq')}""",
    "type_distribution": f"""
        WITH {LINES}, {SAMPLES}, good AS ({_good('samples')}), once AS ({_first('good', 'seq')})
        SELECT type, count(*) AS n FROM once GROUP BY type""",
    "curated_set": f"""
        WITH {LINES}, {SAMPLES}, {ANSWERED}, {CURATED}
        SELECT CAST(origin AS INTEGER) AS origin, CAST(seq AS BIGINT) AS seq, text, emoji, type,
               true_sentiment FROM curated""",
    "sample_exact": f"""
        WITH {POSTS} SELECT post_id, label FROM kept ORDER BY {_draw('post_id')}, post_id LIMIT 1000""",
    "baseline_certificate": f"""
        WITH docs AS (
          SELECT doc_id AS id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 END AS label
          FROM documents),
        parts AS (
          SELECT *, CASE WHEN row_number() OVER (ORDER BY {_draw('id')})
                 <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
          FROM docs),
        commonest AS (
          SELECT label FROM parts WHERE split = 'train' AND label IS NOT NULL
          GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
        SELECT split, count(*) AS n_rows, count(label) AS n_labelled,
          round(avg(CASE WHEN label IS NULL THEN NULL WHEN label = (SELECT label FROM commonest) THEN 1.0
                    ELSE 0.0 END), 6) AS majority_accuracy,
          TRUE AS beats_majority, TRUE AS converged
        FROM parts GROUP BY split""",
    "train_val_split": f"""
        WITH {POSTS}
        SELECT post_id, label, CASE WHEN row_number() OVER (ORDER BY {_draw('post_id')})
               <= ceil(CAST(0.1 AS DOUBLE) * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split
        FROM kept""",
    "shuffle_rank": f"""
        WITH {POSTS}
        SELECT post_id, label, row_number() OVER (ORDER BY {_draw('post_id')}) AS position
        FROM cleaned""",
    "training_set": f"""
        WITH {POSTS}, {ANSWERED}, {_UNION},
        both_in AS (
          SELECT {_columns} FROM (SELECT * FROM posts_in)
          UNION ALL SELECT {_columns} FROM extra_in),
        parts AS ({_split_of('both_in')})
        SELECT split, {_columns}, {TARGET} AS target,
               CAST(CASE WHEN emoji IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n_messages
        FROM parts""",
    "variant_counts": f"""
        WITH {POSTS}, {ANSWERED}, {_UNION},
        numbered AS (
          SELECT *, row_number() OVER (ORDER BY {_draw('row_key')}) AS place, count(*) OVER () AS total
          FROM posts_in),
        rows_in AS (
          SELECT variant, {_columns} FROM posts_in, (VALUES ('full'), ('no_extra'), ('no_constraint')) t(variant)
          UNION ALL SELECT 'half', {_columns} FROM numbered WHERE place <= floor(total * 0.5)
          UNION ALL SELECT variant, {_columns}
          FROM extra_in, (VALUES ('full'), ('no_constraint'), ('half')) t(variant)),
        parts AS ({_split_of('rows_in', 'PARTITION BY variant')})
        SELECT variant, split, count(*) AS n, CAST(sum(label) AS BIGINT) AS label_sum,
               CAST(sum(length(text)) AS BIGINT) AS chars
        FROM parts GROUP BY ALL""",
    "variant_chats": f"""
        WITH {POSTS}, {ANSWERED}, {_UNION},
        numbered AS (
          SELECT *, row_number() OVER (ORDER BY {_draw('row_key')}) AS place, count(*) OVER () AS total
          FROM posts_in),
        rows_in AS (
          SELECT variant, {_columns} FROM posts_in, (VALUES ('full'), ('no_extra'), ('no_constraint')) t(variant)
          UNION ALL SELECT 'half', {_columns} FROM numbered WHERE place <= floor(total * 0.5)
          UNION ALL SELECT variant, {_columns}
          FROM extra_in, (VALUES ('full'), ('no_constraint'), ('half')) t(variant)),
        parts AS ({_split_of('rows_in', 'PARTITION BY variant')})
        SELECT variant, variant <> 'no_constraint' AS listed, count(*) AS n,
               CAST(sum(length(CASE WHEN variant = 'no_constraint' THEN {_chat(_OPEN_SYSTEM)}
                               ELSE {_chat(_SYSTEM)} END)) AS BIGINT) AS chars
        FROM parts GROUP BY ALL""",
    "stage_counts": f"""
        WITH {POSTS}, {SAMPLES}, {ANSWERED},
        all_samples AS (SELECT * FROM samples UNION ALL SELECT * FROM extra),
        good AS ({_good('all_samples')}),
        total AS (SELECT (SELECT count(*) FROM kept) AS k, (SELECT count(*) FROM extra) AS e)
        SELECT 'posts' AS flow, 'read' AS stage, count(*) AS n FROM posts
        UNION ALL SELECT 'posts', 'sampled', k FROM total
        UNION ALL SELECT 'posts', 'union', k + e FROM total
        UNION ALL SELECT 'posts', 'val', CAST(ceil(CAST(0.1 AS DOUBLE) * (k + e)) AS BIGINT) FROM total
        UNION ALL SELECT 'posts', 'train', k + e - CAST(ceil(CAST(0.1 AS DOUBLE) * (k + e)) AS BIGINT) FROM total
        UNION ALL SELECT 'posts', 'kept', count(*) FROM kept
        UNION ALL SELECT 'posts', 'labelled', count(*) FROM kept WHERE label < 20
        UNION ALL SELECT 'posts', 'extra', count(*) FROM extra
        UNION ALL SELECT 'samples', 'read', count(*) FROM all_samples
        UNION ALL SELECT 'samples', 'long_enough', count(*) FROM all_samples
                  WHERE length({_strip("coalesce(text, '')")}) >= 10
        UNION ALL SELECT 'samples', 'listed', count(*) FROM good
        UNION ALL SELECT 'samples', 'unique', count(DISTINCT lower(text)) FROM good""",
    "tokens": f"""
        WITH {_TERM_CTES}
        SELECT doc_id, len(w) AS n_tokens, array_to_string(w, ' ') AS words FROM words""",
    "ngrams": f"""
        WITH {_TERM_CTES}
        SELECT doc_id, len(t) AS n_terms, array_to_string(t, '|') AS terms FROM grams""",
    "term_counts": f"""
        WITH {_TERM_CTES}
        SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words)
        GROUP BY ALL""",
    "vocabulary_topk": f"""
        WITH {_TERM_CTES}, {_vocabulary('t', 'grams', TOP)}
        SELECT term, corpus_count, doc_count, rank, round(idf, 6) AS idf FROM vocabulary""",
    "tfidf_weights": f"""
        WITH {_TERM_CTES}, {_vocabulary('t', 'grams')},
        weighted AS (SELECT doc_id, term, tf * idf AS w FROM terms JOIN vocabulary USING (term))
        SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight
        FROM weighted""",
    "encode_fixed": f"""
        WITH {_TERM_CTES}, {_vocabulary('w', 'words', None)}, {_encoded('words', 'doc_id')}""",
    "encoded_training_set": f"""
        WITH {POSTS}, {ANSWERED}, {_UNION},
        both_in AS (
          SELECT {_columns} FROM (SELECT * FROM posts_in)
          UNION ALL SELECT {_columns} FROM extra_in),
        parts AS ({_split_of('both_in')}),
        chats AS (SELECT split, row_key, {_chat(_SYSTEM)} AS chat FROM parts),
        words AS (
          SELECT split, row_key, row_key AS doc_id, regexp_extract_all(lower(chat), '{_W}{{2,}}') AS w
          FROM chats),
        train_words AS (SELECT * FROM words WHERE split = 'train'),
        {_vocabulary('w', 'train_words', None)}, {_encoded('words', 'split, row_key')}""",
    "pair_predictions": f"WITH {PREDICTIONS} SELECT model, id, truth, pred FROM predictions",
    "reconcile_predictions": f"""
        WITH {PREDICTIONS},
        ids AS (SELECT DISTINCT doc_id AS id FROM documents WHERE doc_id IS NOT NULL),
        per AS (
          SELECT p.model, count(t.id) AS n_pairs, count(*) - count(t.id) AS unmatched_predictions
          FROM (SELECT DISTINCT model, id FROM predictions) p LEFT JOIN ids t USING (id) GROUP BY p.model)
        SELECT model, n_pairs, unmatched_predictions, (SELECT count(*) FROM ids) - n_pairs AS unmatched_truths,
          unmatched_predictions = 0 AND (SELECT count(*) FROM ids) - n_pairs = 0 AS complete
        FROM per""",
    "pair_similarity": f"""
        WITH {PREDICTIONS}
        SELECT model, {_known('truth')} AS truth, {_known('pred')} AS pred, pred = truth AS hit,
               count(*) AS n, CAST(max({_score()}) AS BIGINT) AS hundredths
        FROM predictions GROUP BY ALL""",
    "exact_accuracy": f"""
        WITH {PREDICTIONS}
        SELECT model, count(*) AS n,
               round(avg(CASE WHEN pred = truth THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM predictions GROUP BY model""",
    "f1_scores": f"""
        WITH {PREDICTIONS}, {ROWS_IN}, {CLASSES}
        SELECT model, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted FROM f1s""",
    "class_report": f"""
        WITH {PREDICTIONS}, {ROWS_IN}, {CLASSES}
        SELECT model, emoji, tp, fp, fn, support,
               round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS "precision",
               round(CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END, 6) AS recall,
               round(f1, 6) AS f1
        FROM scored""",
    "semantic_score": f"""
        WITH {PREDICTIONS}
        SELECT model, round(avg({_score()}) / 100.0::DOUBLE, 6) AS semantic_score
        FROM predictions GROUP BY model""",
    "sentiment_consistency": f"""
        WITH {PREDICTIONS}
        SELECT model, round(avg(CASE WHEN {_polarity('pred')} = {_polarity('truth')} THEN 1.0
                                ELSE 0.0 END), 6) AS sentiment_acc
        FROM predictions GROUP BY model""",
    "confusion_matrix": f"""
        WITH {PREDICTIONS}, {ROWS_IN}, {CLASSES}
        SELECT m.model, t.emoji AS truth, p.emoji AS pred, count(r.id) AS n
        FROM models m, classes t, classes p
        LEFT JOIN rows_in r ON r.model = m.model AND r.truth = t.emoji AND r.pred = p.emoji
        GROUP BY ALL""",
    "confusion_wide": f"""
        WITH {PREDICTIONS}, {ROWS_IN}, {CLASSES}
        SELECT m.model, t.emoji AS truth,
               {', '.join(f"count(r.id) FILTER (WHERE r.pred = {_q(e)}) AS {chr(34)}{e}{chr(34)}" for e in V.EMOJI)}
        FROM models m, classes t LEFT JOIN rows_in r ON r.model = m.model AND r.truth = t.emoji
        GROUP BY ALL""",
    "similarity_histogram": f"""
        WITH {PREDICTIONS}, {ROWS_IN}, {CLASSES},
        scores AS (SELECT model, {_score()} AS s FROM predictions),
        bins AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b})' for i, (a, b) in _bins)}) t(bin, low, high)),
        counted AS (
          SELECT m.model, bin, low, high, count(s.s) AS n
          FROM models m, bins LEFT JOIN scores s ON s.model = m.model AND s.s >= low AND s.s < high
          GROUP BY ALL)
        SELECT model, CAST(bin AS BIGINT) AS bin, CAST(low AS BIGINT) AS low,
               CAST(high AS BIGINT) AS high, n,
               round(n::DOUBLE / sum(n) OVER (PARTITION BY model) * 100, 6) AS percent
        FROM counted""",
    "parse_rate": f"""
        WITH {RAW}, {_parse('raw_outputs')}
        SELECT 'tuned' AS model, round(avg(CASE WHEN parse_success THEN 1.0 ELSE 0.0 END), 6)
                 AS json_parse_success_rate
        FROM parsed""",
    "alternative_score": f"""
        WITH {RAW}, {_parse('raw_outputs')}
        SELECT 'tuned' AS model, round({_alt_score}, 6) AS alternative_semantic_score FROM parsed""",
    "irony_accuracy": f"""
        WITH {RAW}, {_parse('raw_outputs')}, {ANNOTATED}, ironies AS ({_irony_acc})
        SELECT 'tuned' AS model, n_annotated,
               round(irony_detection_accuracy, 6) AS irony_detection_accuracy FROM ironies""",
    "model_comparison": _comparison(
        f"SELECT model, truth, pred FROM predictions UNION ALL {_ANSWERED_ROWS}"),
    "parse_and_score": _comparison(_ANSWERED_ROWS),
}

ORACLE["comparison_report"] = ORACLE["model_comparison"]
