"""SQL views that mirror ``sources/adapters.py`` and the shared transforms, for the oracle queries."""

from __future__ import annotations

from groundwire.functions import routing, sensitive
from groundwire.functions.text import WHITESPACE_CHARS, WHITESPACE_RANGES, WORD_PATTERN
from groundwire.sources.access_log import INGEST_ROUTES, QUERY_ROUTES


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(template: str, needles) -> str:
    return "(" + " OR ".join(template.format(lit(n)) for n in needles) + ")"


def strip(expression: str) -> str:
    return f"trim({expression}, {lit(WHITESPACE_CHARS)})"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def luhn_cards(text: str) -> str:
    digits = "regexp_replace(c, '[^0-9]', '', 'g')"
    digit = f"CAST(substr(reverse({digits}), CAST(p AS INTEGER), 1) AS INTEGER)"
    return (
        f"list_filter(regexp_extract_all({text}, {lit(sensitive.PATTERNS[sensitive.CARD])}), lambda c: "
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda p: CASE WHEN p % 2 = 1 THEN {digit} "
        f"WHEN 2 * {digit} > 9 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0)"
    )


def masked(text: str, prefix: str = "m") -> tuple[str, str]:
    """CTE chain that masks column ``text`` of relation ``{prefix}0``; returns (ctes, last relation)."""
    ctes, n = [], 0
    for entity in sensitive.ENTITY_TYPES:
        if entity not in sensitive.PATTERNS:
            continue
        token = lit("{" + entity + "}")
        if entity == sensitive.CARD:
            expression = f"list_reduce(list_prepend({text}, {luhn_cards(text)}), lambda a, c: replace(a, c, {token}))"
        else:
            expression = f"regexp_replace({text}, {lit(sensitive.PATTERNS[entity])}, {token}, 'g')"
        ctes.append(f"{prefix}{n + 1} AS (SELECT * REPLACE ({expression} AS {text}) FROM {prefix}{n})")
        n += 1
    return ", ".join(ctes), f"{prefix}{n}"


def after_start(minutes: str) -> str:
    return f"(TIMESTAMP '2024-01-01' + to_minutes(CAST({minutes} AS BIGINT)))"


REQUESTS = f"""requests AS (
  SELECT conv_id*1000+turn AS request_id, CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn,
    CASE (conv_id*7+turn)%8
      WHEN 0 THEN 'hello there'
      WHEN 1 THEN 'What is item ' || conv_id || '?'
      WHEN 2 THEN 'Compare ' || text
      WHEN 3 THEN 'Write a function for ' || text
      WHEN 4 THEN text || '? ' || text || '?'
      ELSE text END AS query,
    (conv_id*7+turn)%8 = 5 AS has_image,
    CASE WHEN (conv_id*7+turn)%8 = 6 THEN 'reasoning' END AS override_tier,
    {after_start('conv_id*60+turn')} AS requested_at
  FROM conversations WHERE role = 'user')"""

_RULES = (
    (routing.REASON_IMAGE, "reasoning", 0.97), (routing.REASON_CODE, "reasoning", 0.93),
    (routing.REASON_HINT, "reasoning", 0.88), (routing.REASON_LONG, "reasoning", 0.78),
    (routing.REASON_GREETING, "fast", 0.96), (routing.REASON_FAQ, "fast", 0.84),
    (routing.REASON_SHORT, "fast", 0.72), (routing.REASON_AMBIGUOUS, "reasoning", 0.55),
)


def _by_rule(index: int) -> str:
    def value(v):
        return lit(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)"

    return "CASE rule " + " ".join(f"WHEN {n} THEN {value(r[index])}" for n, r in enumerate(_RULES, 1)) + " END"


CLASSIFIED = REQUESTS + f""",
stripped AS (SELECT *, {strip('query')} AS s, lower({strip('query')}) AS l FROM requests),
prepared AS (SELECT *, len(regexp_extract_all(l, {lit(WORD_PATTERN)})) AS w,
  {strip("regexp_replace(l, " + lit("[^a-z" + WHITESPACE_RANGES + "']") + ", '', 'g')")} AS c FROM stripped),
ruled AS (SELECT *, CASE
  WHEN has_image THEN 1
  WHEN regexp_matches(s, {lit('|'.join(routing.CODE_MARKERS))}, 'i') THEN 2
  WHEN {any_of('contains(l, {})', routing.REASONING_HINTS)} THEN 3
  WHEN len(regexp_extract_all(l, '[?]')) >= 2 OR length(s) > 480 OR w > 80 THEN 4
  WHEN c IN {in_list(routing.GREETINGS)} OR (w <= 6 AND {any_of('starts_with(c, {})', routing.GREETINGS)}) THEN 5
  WHEN w <= 14 AND ({any_of('starts_with(l, {})', routing.FAST_HINTS)}
    OR {any_of("contains(' ' || l || ' ', ' ' || {} || ' ')", routing.FAST_HINTS)}) THEN 6
  WHEN w <= 8 THEN 7 ELSE 8 END AS rule FROM prepared),
classified AS (SELECT request_id, session_id, conv_id, turn, query, has_image, override_tier, requested_at,
  {_by_rule(1)} AS tier, {_by_rule(0)} AS reason, 'heuristic' AS source, {_by_rule(2)} AS confidence FROM ruled)"""

ANSWERS = """answers AS (
  SELECT conv_id*1000+turn AS answer_id, CAST(conv_id AS VARCHAR) AS session_id,
    CASE (conv_id+turn)%5 WHEN 0 THEN 'I''m not sure. ' || text
      WHEN 1 THEN text || ' Sources: s3://docs/' || conv_id
      WHEN 2 THEN text || ' Sources: s3://missing/' || conv_id ELSE text END AS answer
  FROM conversations WHERE role = 'assistant')"""

LOW_CONFIDENCE = any_of("contains(lower(answer), {})", routing.LOW_CONFIDENCE_MARKERS)

CALLS = CLASSIFIED + """,
spread AS (SELECT *, (conv_id*3+turn)%8 AS m, (conv_id+turn)%3 = 0 AS doubt, (conv_id+turn)%6 = 0 AS policy FROM classified),
numbered AS (SELECT *, CAST(unnest(range(0, least(5, m + CASE WHEN doubt THEN 1 ELSE 0 END) + 1)) AS BIGINT) AS i FROM spread),
named AS (SELECT *, CASE WHEN i < m THEN CASE (conv_id+turn+i)%5 WHEN 0 THEN 'analyze_image'
  WHEN 4 THEN 'unknown_tool' ELSE 'retrieve_knowledge' END END AS tool FROM numbered),
calls AS (SELECT request_id, session_id, i, requested_at,
  CASE WHEN i < m THEN 'tool_use' WHEN i = m AND policy THEN 'guardrail_intervened' ELSE 'end_turn' END AS stop_reason,
  tool, CASE WHEN i < m THEN CASE WHEN (conv_id+turn+i)%6 = 0 THEN [tool, tool] ELSE [tool] END ELSE [] END AS tools,
  CASE WHEN i < m THEN request_id || '-' || i END AS tool_use_id,
  CASE WHEN i >= m AND NOT (i = m AND policy) THEN CASE WHEN i = m AND doubt THEN 'I''m not sure.' ELSE 'Done.' END END AS answer,
  i + 10 AS input_tokens, (i + 1) * 5 AS output_tokens, (conv_id+turn+i)*37 AS latency_ms,
  tier, reason, source, (i = m AND policy) AS has_trace
  FROM named)"""

TOOL_RESULTS = CALLS + """,
tool_calls AS (SELECT request_id, i, requested_at, CAST(0 AS BIGINT) AS position, tool_use_id, tool, '{"call":0}' AS input
  FROM calls WHERE tool_use_id IS NOT NULL
  UNION ALL SELECT request_id, i, requested_at, 1, tool_use_id || 'b',
    CASE tool WHEN 'retrieve_knowledge' THEN 'analyze_image' ELSE 'retrieve_knowledge' END, '{"call":1}' FROM calls WHERE len(tools) = 2),
tool_results AS (SELECT request_id, tool_use_id, 'result ' || tool_use_id AS result FROM tool_calls
  WHERE request_id IN
    (SELECT conv_id*1000+turn-1 FROM conversations WHERE role = 'assistant')),
paired AS (SELECT c.request_id, c.i, c.requested_at, c.position, c.input, c.tool_use_id, c.tool,
  CASE WHEN tool NOT IN ('analyze_image', 'retrieve_knowledge') OR result IS NULL THEN 'error' ELSE 'success' END AS status,
  CASE WHEN tool NOT IN ('analyze_image', 'retrieve_knowledge') THEN '{"error":"Unknown tool: ' || tool || '"}'
    WHEN result IS NULL THEN '{"error":"no result"}' ELSE substr(result, 1, 1500) END AS output_preview
  FROM tool_calls c LEFT JOIN tool_results r USING (request_id, tool_use_id))"""

LOOPED = CALLS + f""",
flagged AS (SELECT *, stop_reason = 'tool_use' AS is_tool, stop_reason = 'guardrail_intervened' AS is_policy,
  CASE WHEN tier <> 'fast' OR stop_reason = 'guardrail_intervened' THEN NULL
    WHEN stop_reason = 'tool_use' AND (list_contains(tools, 'analyze_image') OR i >= 1 OR len(tools) > 1)
      THEN 'complex or multi-step tool use'
    WHEN stop_reason <> 'tool_use' AND {LOW_CONFIDENCE} THEN 'low-confidence fast-tier answer' END AS cause
  FROM calls),
first_events AS (SELECT request_id, min(i) FILTER (cause IS NOT NULL) AS candidate,
  min(i) FILTER (is_policy OR (NOT is_tool AND cause IS NULL)) AS early, max(i) AS last_i FROM flagged GROUP BY 1),
escalations AS (SELECT *, CASE WHEN early IS NULL OR candidate < early THEN candidate END AS escalated_at FROM first_events),
late_stops AS (SELECT f.request_id, min(f.i) FILTER ((is_policy OR NOT is_tool) AND f.i > e.escalated_at) AS late
  FROM flagged f JOIN escalations e USING (request_id) GROUP BY 1),
runs AS (SELECT request_id, escalated_at, last_i, CASE WHEN escalated_at IS NULL THEN early ELSE late END AS stopped_at
  FROM escalations JOIN late_stops USING (request_id)),
looped AS (SELECT f.*, r.escalated_at, r.stopped_at,
  CASE WHEN f.i > r.escalated_at THEN 'reasoning' ELSE f.tier END AS effective_tier,
  CASE WHEN f.i = r.escalated_at THEN f.cause END AS escalation,
  coalesce(f.i = r.escalated_at, false) AS discarded,
  CASE WHEN r.stopped_at IS NOT NULL THEN CASE WHEN (SELECT is_policy FROM flagged g
      WHERE g.request_id = f.request_id AND g.i = r.stopped_at) THEN 'guardrail' ELSE 'answered' END
    WHEN r.last_i = 5 THEN 'max iterations' ELSE 'incomplete' END AS stop_cause
  FROM flagged f JOIN runs r USING (request_id) WHERE r.stopped_at IS NULL OR f.i <= r.stopped_at)"""

ROUTED_LOG = f"""access_log AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS caller, ts,
    CASE event_id%5 WHEN 0 THEN '/v1/query/' WHEN 1 THEN '/v1/health' WHEN 2 THEN '/v1/uploads/presign'
      WHEN 3 THEN '/v1/ingest' ELSE '/unknown' END AS path,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 429 ELSE 200 END AS status,
    CAST(round(value * 200) AS BIGINT) AS latency_ms FROM events),
routes AS (SELECT *, 'POST ' || rtrim(path, '/') AS route FROM access_log),
services AS (SELECT *, CASE WHEN route IN {in_list(QUERY_ROUTES)} THEN 'query'
  WHEN route IN {in_list(INGEST_ROUTES)} THEN 'ingest' ELSE 'unknown' END AS service FROM routes),
routed_log AS (SELECT *, CAST(CASE WHEN service = 'unknown' THEN 404 ELSE status END AS BIGINT) AS outcome FROM services)"""

DASHBOARD = ROUTED_LOG + """,
dashboard AS (SELECT date_trunc('minute', ts) AS period,
  count(*) FILTER (service = 'query' AND outcome >= 500) AS query_errors,
  count(*) FILTER (service = 'ingest' AND outcome >= 500) AS ingest_errors,
  count(*) FILTER (outcome >= 500) AS api_5xx,
  round(avg(latency_ms) FILTER (service = 'query'), 4) AS query_duration_ms,
  count(*) FILTER (service = 'query') AS query_invocations,
  count(*) FILTER (service = 'ingest') AS ingest_invocations,
  count(*) FILTER (service = 'query' AND outcome = 429) AS query_throttles
  FROM routed_log GROUP BY 1)"""

ERROR_SERIES = DASHBOARD + """,
series AS (SELECT 'QueryErrors' AS alarm, period, query_errors AS value FROM dashboard
  UNION ALL SELECT 'IngestErrors', period, ingest_errors FROM dashboard
  UNION ALL SELECT 'Api5xx', period, api_5xx FROM dashboard)"""

LATENCY = ROUTED_LOG + """,
latency AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2024-01-01') AS period,
  round(quantile_cont(latency_ms, 0.99), 4) AS value, count(*) AS calls FROM routed_log GROUP BY 1)"""

_KIND_PREFIX = "CASE doc_id%3 WHEN 0 THEN 'knowledge/' WHEN 1 THEN 'uploads/' ELSE 'logs/' END"
_CREATED = after_start("(doc_id%120)*1440 + doc_id%1440")

OBJECTS = f"""objects AS (
  SELECT CASE WHEN doc_id%3 = 0 THEN 'documents' WHEN doc_id%3 = 1 THEN 'uploads'
      WHEN lang = 'en' THEN 'log-groups' ELSE 'logs' END AS bucket,
    {_KIND_PREFIX} || lang || '/' || (n_chars%40) AS key, doc_id AS version_id, {_CREATED} AS created,
    CASE WHEN doc_id%4 = 2 THEN 'incomplete' ELSE 'stored' END AS state, n_chars AS size FROM documents)"""

KNOWLEDGE = f"""knowledge_documents AS (
  SELECT doc_id, source, {_KIND_PREFIX} || doc_id AS key,
    's3://' || source || '/' || {_KIND_PREFIX} || doc_id AS uri, text, {_CREATED} AS ts FROM documents)"""

JOBS = f"""{KNOWLEDGE}, jobs AS (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS period, count(*) AS uploaded, CAST(1 AS BIGINT) AS started, count(*) - 1 AS conflicts
  FROM knowledge_documents GROUP BY 1)"""

ALL_DOCUMENTS = """all_documents AS (
  SELECT 's3://' || source || '/' || doc_id AS uri, source, text FROM documents)"""


def chunks(relation: str, extra: str = "") -> str:
    """CTEs that cut ``relation`` (uri, text) into a relation ``chunks``."""
    return f""",
tokenized AS (SELECT uri{extra}, regexp_extract_all(text, {lit(WORD_PATTERN)}) AS tokens FROM {relation}),
starts AS (SELECT uri{extra}, tokens, unnest(range(0, greatest(len(tokens) - 60, 1), 240)) AS start
  FROM tokenized WHERE len(tokens) > 0),
pieces AS (SELECT uri{extra}, start // 240 AS ordinal, list_slice(tokens, start + 1, start + 300) AS part FROM starts),
chunks AS (SELECT sha256(uri || chr(31) || ordinal || chr(31) || array_to_string(part, ' ')) AS chunk_id, uri{extra},
  CAST(ordinal AS BIGINT) AS ordinal, array_to_string(part, ' ') AS text, CAST(len(part) AS BIGINT) AS n_tokens,
  count(*) OVER (PARTITION BY uri) AS n_chunks FROM pieces)"""


CONTENT_SCORES = """content_scores AS (
  SELECT doc_id AS item_id, 'INSULTS' AS category, 'input' AS direction, CAST(toxic AS DOUBLE) AS score FROM labels
  UNION ALL SELECT doc_id, 'PROMPT_ATTACK', 'input', (1 - quality) * 0.4 FROM labels
  UNION ALL SELECT doc_id, 'PROMPT_ATTACK', 'output', CAST(toxic AS DOUBLE) FROM labels
  UNION ALL SELECT doc_id, 'HATE', 'output', toxic * 0.5 FROM labels)"""
