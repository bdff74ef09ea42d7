"""Content policy, sensitive data and vision."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundwire.functions import sensitive
from groundwire.operators import phrases, policy, vision
from groundwire.plans import oracle_views as v
from groundwire.plans.registry import register
from groundwire.sources import adapters

_MASK_CTES, _MASKED = v.masked("text")
# Extra topic with terms the test corpus does contain; topics are a parameter of the operator.
TOPICS = {**policy.DENIED_TOPICS, "Credentials": ("token =", "password")}


@register("anonymize_documents", f"""WITH m0 AS (SELECT doc_id, text, text AS original FROM documents), {_MASK_CTES}
  SELECT doc_id, text AS masked, text <> original AS anonymized FROM {_MASKED}""")
def anonymize_documents(spark, sf_dir):
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    return policy.anonymize(documents, "text").drop("text")


#: Names and addresses are lists of the caller; these occur in the test corpus.
NAMES, ADDRESSES = ("Ershat", "onan", "thinor"), ("of the", "un de la")
_WORD = r"\p{L}\p{N}_"


def _whole_words(text: str, pattern: str, entity: str) -> str:
    """Twice, since neighbours share the character between them."""
    whole = v.lit(f"(?i)(^|[^{_WORD}])(?:{pattern})($|[^{_WORD}])")
    once = f"regexp_replace({text}, {whole}, '\\1{{{entity}}}\\2', 'g')"
    return f"regexp_replace({once}, {whole}, '\\1{{{entity}}}\\2', 'g')"


_LISTED = _whole_words(
    _whole_words("text", "ershat|onan|thinor", "NAME"), f"of[{v.WHITESPACE_RANGES}]+the|un[{v.WHITESPACE_RANGES}]+de[{v.WHITESPACE_RANGES}]+la", "ADDRESS"
)


@register("anonymize_listed", f"""WITH m0 AS (SELECT doc_id, text, text AS original FROM documents), {_MASK_CTES}
  SELECT doc_id, {_LISTED} AS masked, {_LISTED} <> original AS anonymized FROM {_MASKED}""")
def anonymize_listed(spark, sf_dir):
    """All eight types: those with a pattern, and names and addresses from lists, as whole words."""
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    return policy.anonymize(documents, "text", names=NAMES, addresses=ADDRESSES).drop("text")


def word_runs(texts, size):
    """All runs of ``size`` words of the column ``text``, as phrases."""
    words = texts.select(F.regexp_extract_all(F.lower("text"), F.lit(f"[{_WORD}]+"), F.lit(0)).alias("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, F.lit(size)), " "))
    return words.filter(F.size("w") >= size).select(F.explode(runs).alias("phrase"))


def listed_phrases(spark, sf_dir):
    """Lists as long as the table makes them: the pairs of words of the benchmark, and its runs of three."""
    items = adapters.table(spark, sf_dir, "benchmark")
    names = word_runs(items, 2).withColumn("entity", F.lit("NAME"))
    return names.unionByName(word_runs(items, 3).withColumn("entity", F.lit("ADDRESS")))


def _runs_sql(table: str, size: int) -> str:
    run = " || ' ' || ".join(f"lead(w, {n}) OVER (PARTITION BY rowid ORDER BY i)" if n else "w" for n in range(size))
    words = f"""SELECT row_number() OVER () AS rowid, regexp_extract_all(lower(text), '[{_WORD}]+') AS t FROM {table}"""
    return f"SELECT DISTINCT {run} AS phrase FROM (SELECT rowid, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM ({words}))"


_TOKENS = f"""tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[{_WORD}]+|[^{_WORD}{v.WHITESPACE_RANGES}]') AS t FROM documents),
places AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tokens),
runs AS (SELECT doc_id, w || ' ' || lead(w) OVER d AS two, w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d AS three,
  w || ' ' || lead(w) OVER d || ' ' || lead(w, 2) OVER d || ' ' || lead(w, 3) OVER d AS four FROM places WINDOW d AS (PARTITION BY doc_id ORDER BY i))"""


@register("phrase_matches", f"""WITH {_TOKENS}, names AS ({_runs_sql('benchmark', 2)}), addresses AS ({_runs_sql('benchmark', 3)})
  SELECT doc_id, 'NAME' AS entity, count(*) AS matches FROM runs JOIN names ON two = phrase GROUP BY 1
  UNION ALL SELECT doc_id, 'ADDRESS', count(*) FROM runs JOIN addresses ON three = phrase GROUP BY 1""")
def phrase_matches(spark, sf_dir):
    """Phrases of long lists in every document, as whole words."""
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrases.phrase_matches(documents, "text", listed_phrases(spark, sf_dir), policy.LISTED)


@register("screen_topic_lists", f"""WITH {_TOKENS}, planted AS ({_runs_sql('benchmark', 4)}),
  found AS (SELECT DISTINCT doc_id, 1 AS place, 'Benchmark' AS topic FROM runs JOIN planted ON four = phrase
    UNION ALL SELECT DISTINCT doc_id, 2, 'Credentials' FROM places WHERE w IN ('token', 'password'))
  SELECT doc_id, coalesce(string_agg(topic, '; ' ORDER BY place), '') AS topics FROM documents LEFT JOIN found USING (doc_id) GROUP BY 1""")
def screen_topic_lists(spark, sf_dir):
    """Topics whose listed phrases occur: runs of four words of the benchmark, and words for credentials."""
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = word_runs(adapters.table(spark, sf_dir, "benchmark"), 4).withColumn("entity", F.lit("Benchmark"))
    secrets = spark.createDataFrame([("token", "Credentials"), ("password", "Credentials")], "phrase string, entity string")
    screened = phrases.screen_topic_lists(documents, "text", planted.unionByName(secrets), ("Benchmark", "Credentials"))
    return screened.select("doc_id", F.array_join("topics", "; ").alias("topics"))


@register("anonymize_turns", f"""WITH m0 AS (SELECT conv_id, turn, text, text AS original FROM conversations), {_MASK_CTES}
  SELECT conv_id, turn, text AS masked, text <> original AS anonymized FROM {_MASKED}""")
def anonymize_turns(spark, sf_dir):
    turns = adapters.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return policy.anonymize(turns, "text").drop("text")


def _topics_sql(column: str) -> str:
    cases = ", ".join(
        f"CASE WHEN {v.any_of('contains(lower(' + column + '), {})', terms)} THEN {v.lit(name)} END"
        for name, terms in TOPICS.items()
    )
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


@register("screen_topics", f"""
  SELECT doc_id, array_to_string({_topics_sql('text')}, '; ') AS topics FROM documents""")
def screen_topics(spark, sf_dir):
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    return policy.screen_topics(documents, "text", TOPICS).select("doc_id", F.array_join("topics", "; ").alias("topics"))


_SCREENED = v.CONTENT_SCORES + """,
screened AS (SELECT item_id, direction,
  bool_or(score >= 0.5 AND NOT (category = 'PROMPT_ATTACK' AND direction = 'output')) AS blocked,
  count(*) FILTER (score >= 0.5 AND NOT (category = 'PROMPT_ATTACK' AND direction = 'output')) AS categories_over,
  max(score) AS max_score FROM content_scores GROUP BY 1, 2)"""


@register("screen_content", f"WITH {_SCREENED} SELECT * FROM screened")
def screen_content(spark, sf_dir):
    return policy.screen_content(adapters.content_scores(spark, sf_dir))


def _policed_sql(direction: str, message: str) -> str:
    return f"""{_SCREENED}, m0 AS (SELECT doc_id AS item_id, text, text AS original FROM documents), {_MASK_CTES},
policed AS (SELECT m.item_id, array_to_string({_topics_sql('original')}, '; ') AS topics,
  len({_topics_sql('original')}) > 0 OR coalesce(s.blocked, false) AS is_blocked, text, original
  FROM {_MASKED} m LEFT JOIN screened s ON s.item_id = m.item_id AND s.direction = '{direction}'),
acted AS (SELECT item_id, topics, CASE WHEN is_blocked THEN 'blocked' WHEN text <> original THEN 'anonymized' ELSE 'none' END AS action,
  CASE WHEN is_blocked THEN {v.lit(message)} ELSE text END AS output_text FROM policed)"""


_POLICED = _policed_sql("input", policy.BLOCKED_INPUT)
_POLICED_OUTPUT = _policed_sql("output", policy.BLOCKED_OUTPUT)


def policed(spark, sf_dir, direction="input"):
    documents = adapters.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    verdicts = policy.screen_content(adapters.content_scores(spark, sf_dir))
    return policy.apply_policy(documents, verdicts, direction, topics=TOPICS)


@register("apply_policy", f"WITH {_POLICED} SELECT * FROM acted")
def apply_policy(spark, sf_dir):
    return policed(spark, sf_dir).select(
        "item_id", F.array_join("topics", "; ").alias("topics"), "action", "output_text"
    )


@register("apply_policy_output", f"WITH {_POLICED_OUTPUT} SELECT * FROM acted")
def apply_policy_output(spark, sf_dir):
    """Documents as generated answers: the output strengths and the output message."""
    return policed(spark, sf_dir, "output").select(
        "item_id", F.array_join("topics", "; ").alias("topics"), "action", "output_text"
    )


@register("policy_actions", f"WITH {_POLICED} SELECT action, count(*) AS items FROM acted GROUP BY 1")
def policy_actions(spark, sf_dir):
    return policy.action_counts(policed(spark, sf_dir))


def _count_sql(entity: str) -> str:
    found = v.luhn_cards("text") if entity == sensitive.CARD else f"regexp_extract_all(text, {v.lit(sensitive.PATTERNS[entity])})"
    return f"SELECT bucket, object_id, {v.lit(entity)} AS entity, {v.lit(sensitive.SEVERITY[entity])} AS severity, len({found}) AS matches FROM stored"


MATCHES_SQL = """stored AS (
  SELECT 'documents' AS bucket, CAST(doc_id AS VARCHAR) AS object_id, text FROM documents
  UNION ALL SELECT 'uploads', CAST(page_id AS VARCHAR), html FROM pages),
found AS (""" + " UNION ALL ".join(_count_sql(e) for e in sensitive.ENTITY_TYPES if e in sensitive.PATTERNS) + """),
matches AS (SELECT * FROM found WHERE matches > 0)"""
FINDINGS_SQL = f"""WITH {MATCHES_SQL} SELECT bucket, entity, severity, count(*) AS objects, CAST(sum(matches) AS BIGINT) AS matches
  FROM matches GROUP BY 1, 2, 3"""


def scanned_objects(spark, sf_dir):
    documents = adapters.table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("bucket"), F.col("doc_id").cast("string").alias("object_id"), "text"
    )
    return documents.unionByName(adapters.table(spark, sf_dir, "pages").select(
        F.lit("uploads").alias("bucket"), F.col("page_id").cast("string").alias("object_id"), F.col("html").alias("text")
    ))


@register("pii_matches", f"WITH {MATCHES_SQL} SELECT * FROM matches")
def pii_matches(spark, sf_dir):
    return policy.pii_matches(scanned_objects(spark, sf_dir))


@register("pii_findings", FINDINGS_SQL)
def pii_findings(spark, sf_dir):
    return policy.pii_findings(scanned_objects(spark, sf_dir))


_VISION = """seen AS (SELECT CAST(vec_id AS VARCHAR) AS image_id, CAST(embedding AS DOUBLE[]) AS e,
  CASE WHEN label = 0 THEN 70.0 ELSE label * 10.0 END AS floor_at FROM embeddings),
labels AS (SELECT image_id, 'label' || (p - 1) AS name, abs(e[p]) * 400 AS confidence, floor_at
  FROM (SELECT *, unnest(range(1, len(e) + 1)) AS p FROM seen)),
kept AS (SELECT image_id, name, confidence FROM labels WHERE confidence >= floor_at
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, name) <= 25)"""


@register("vision_summary", f"""WITH {_VISION},
  emotions AS (SELECT image_id, list_filter(list_transform(range(0, 6), lambda j: CASE WHEN abs(e[CAST(j AS INTEGER) + 10]) * 400 >= floor_at
    THEN 'emotion' || j END), lambda x: x IS NOT NULL) AS found FROM seen)
  SELECT s.image_id, (SELECT count(*) FROM kept k WHERE k.image_id = s.image_id) AS n_labels,
    (SELECT string_agg(name, ',' ORDER BY confidence DESC, name) FROM kept k WHERE k.image_id = s.image_id) AS label_names,
    array_to_string(list_filter([CASE WHEN e[1] > 0 THEN 'text0' END, CASE WHEN e[2] > 0 THEN 'text1' END, CASE WHEN e[3] > 0 THEN 'text2' END,
      CASE WHEN e[4] > 0 THEN 'text3' END], lambda x: x IS NOT NULL), ',') AS text_lines,
    CAST(len(list_filter(list_slice(e, 5, 7), lambda x: x > 0)) AS BIGINT) AS face_count,
    CASE WHEN len(list_filter(list_slice(e, 5, 7), lambda x: x > 0)) > 0 THEN array_to_string(list_slice(m.found, 1, 3), ',') END AS first_face_emotions,
    CAST(len(list_filter(list_slice(e, 20, 22), lambda x: abs(x) * 400 >= floor_at)) AS BIGINT) AS n_moderation
  FROM seen s JOIN emotions m USING (image_id)""")
def vision_summary(spark, sf_dir):
    summary = vision.vision_summary(adapters.detections(spark, sf_dir))
    names = F.array_join(F.transform("labels", lambda x: x["name"]), ",")
    return summary.select(
        "image_id", F.size("labels").cast("bigint").alias("n_labels"),
        F.when(F.size("labels") > 0, names).alias("label_names"),
        F.array_join("text_lines", ",").alias("text_lines"), "face_count",
        F.array_join(F.get("faces", F.lit(0)).getField("emotions"), ",").alias("first_face_emotions"),
        F.size("moderation").cast("bigint").alias("n_moderation"),
    )


@register("vision_label_counts", f"""WITH {_VISION}
  SELECT name, count(*) AS images, CAST(sum(CAST(round(round_even(confidence, 2) * 100) AS BIGINT)) AS BIGINT) / count(*) / 100 AS avg_confidence FROM kept GROUP BY 1""")
def vision_label_counts(spark, sf_dir):
    return vision.label_counts(vision.vision_summary(adapters.detections(spark, sf_dir)))
