"""Rules over conversations, pages and events; phrases are added to turns so that every rule is met."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import decisions as rules
from lodestone.functions.rules import GREETINGS, SCRIPTS, language_of
from lodestone.sources.tables import table

#: Fixed values of these queries: what is said besides the turn, by turn and conversation.
PHRASES = ["", "你好", "玻尿酸 多少钱", "痘痘怎么办", "烟酰胺 是什么", "推荐一款产品", "有什么建议", "最新新闻", "不对,应该是", "台灣 後", "香港 睇", "如何 非常 激光", "谁", "我喜欢 vogue", "where is the schedule", "股价"]
PROMPTS = ["free_chat", "planner", "knowledge", "other"]


def _pick(items, n):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (n % len(items) + 1).cast("int"))


def _said(s, d):
    """Turns with ``said``: a phrase by number, and then the turn's whole text."""
    n = F.col("conv_id") * 7 + F.col("turn") * 3
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.concat(_pick(PHRASES, n), "text").alias("said"), n.alias("n"))


def session_stage(s, d):
    return _said(s, d).select("conv_id", "turn", rules.stage(F.col("said"), F.col("role")).alias("stage"))


def route_decision(s, d):
    model = F.when(F.col("n") % 3 == 0, F.lit(False))
    return _said(s, d).select("conv_id", "turn", rules.route(F.col("said"), model, F.col("n") % 5 == 0).alias("r")).select("conv_id", "turn", "r.*")


def search_decision(s, d):
    return _said(s, d).select("conv_id", "turn", rules.search_need(F.col("said")).alias("r")).select("conv_id", "turn", "r.*")


def search_enabled(s, d):
    return _said(s, d).select("conv_id", "turn", rules.any_of(F.lower("said"), rules.LIVE).alias("live"))


def _injected(s, d):
    at = _pick(["", "Schedule", "beauty_talk", "personal"], F.col("n"))
    return _said(s, d).select("conv_id", "turn", "n", rules.injection(F.col("said"), at).alias("r"))


def injection_needs(s, d):
    return _injected(s, d).select("conv_id", "turn", "r.*")


def injection_policy(s, d):
    return _injected(s, d).select("conv_id", "turn", rules.injection_policy(F.col("r"), _pick(PROMPTS, F.col("n"))).alias("p")).select("conv_id", "turn", "p.*")


def correction_rules(s, d):
    hit = rules.any_of(F.lower("said"), rules.CORRECTION)
    return _said(s, d).select("conv_id", "turn", hit.alias("is_correction"), F.when(hit, 0.7).otherwise(0.1).alias("confidence"), F.when(hit, F.col("said")).otherwise("").alias("content"))


def language_tags(s, d):
    return _said(s, d).select("conv_id", "turn", rules.language_tag(language_of(F.col("said")), F.col("said")).alias("tag"))


def query_simplified(s, d):
    return _said(s, d).select("conv_id", "turn", rules.simplified(F.col("said")).alias("query"))


def query_variants(s, d):
    return _said(s, d).select("conv_id", "turn", F.posexplode(rules.variants(F.trim("said"))).alias("pos", "query"))


def document_classes(s, d):
    """Documents with authority and category by source and phrases; what is there already stays."""
    kind = _pick(["Patent", "paper", "web", "Clinical", "official", "product", "news", "x"], F.col("doc_id"))
    title = _pick(["", "产品 A", "论文 B", "专利 C", "新闻 D"], F.col("doc_id"))
    head = F.concat(_pick(["", "", "临床 ", "医美 "], F.col("doc_id") % 11), F.col("text"))
    source = F.concat(F.col("source"), _pick(["", "专利", "PubMed", "官方"], F.col("doc_id") % 7))
    given = F.when(F.col("doc_id") % 13 == 0, "given")
    return table(s, d, "documents").select("doc_id", F.coalesce(given, rules.authority_level(kind, source)).alias("authority"), F.coalesce(given, rules.category(title, head, kind)).alias("category"))


def page_kind(s, d):
    return table(s, d, "pages").select("page_id", rules.is_content_page(F.col("html")).alias("is_content"))


def time_parts(s, d):
    ts = F.col("ts").cast("timestamp")
    return table(s, d, "events").select(
        "event_id", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("at"), F.date_format(ts, "yyyy年MM月dd日").alias("day"), F.hour(ts).cast("string").alias("hour"), rules.weekday(ts).alias("weekday"), F.hour(ts).between(6, 17).alias("daytime"))


def metrics_window(s, d):
    """Totals of the last ten days up to a day: calls, errors, success rate, users."""
    kept = table(s, d, "events").where("ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAYS AND ts < TIMESTAMP '2024-01-20'")
    errors = F.count_if(F.col("event_type") == "error")
    return kept.agg(F.count(F.lit(1)).alias("calls"), errors.alias("errors"), F.round((1 - errors / F.count(F.lit(1))) * 100, 4).alias("success_rate"), F.countDistinct("user_id").alias("users"))


def metrics_at_hour(s, d):
    """Calls, errors and users of one hour of the day over all days."""
    kept = table(s, d, "events").where(F.hour("ts") == 9)
    return kept.agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.countDistinct("user_id").alias("users"))


def json_arrays(s, d):
    """Replies about items: an array within other words, lines with numbers or quotes, or no list at all."""
    name, brand, size = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("name", "brand", "size"))
    array = F.concat(F.lit('Found ["'), name, F.lit('", "'), brand, F.lit('",\n '), F.coalesce("size", F.lit(0)), F.lit("] so far"))
    lines = F.concat(F.lit("1. "), name, F.lit('\n2. "'), brand, F.lit("\"\n\n  '"), size, F.lit("'\nand no more"))
    reply = F.when(F.col("item_id") % 3 == 0, array).when(F.col("item_id") % 3 == 1, lines).otherwise(name)
    return table(s, d, "items").select("item_id", F.array_join(rules.json_array(reply), "|").alias("items"), F.array_join(rules.json_lines(reply), "|").alias("lines"))


def json_repair(s, d):
    """Clicks' properties as a model would write them: fenced, with a comma too many, comments, and words around."""
    comma = F.regexp_replace("props", r"\}$", ",}")
    n = F.col("click_id") % 4
    broken = F.when(n == 0, F.concat(F.lit("```json\n"), comma, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Sure: "), comma, F.lit(" as asked")))
    broken = broken.when(n == 2, F.concat(F.lit("/* the\nclick */ "), "props", F.lit(" // end"))).otherwise(F.col("props"))
    return table(s, d, "clicks").select("click_id", F.regexp_replace(rules.json_repaired(broken), r"\s+", "").alias("fixed"))


def html_lines(s, d):
    """Lines of pages without short ones and headings, collapsed, cut to 3000; and the first heading."""
    lines = F.split(F.regexp_replace("html", "<[^>]*>", "\n"), "\n")
    kept = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (F.length(x) > 2) & ~x.startswith("#"))
    return table(s, d, "pages").select("page_id", F.md5(F.substring(F.regexp_replace(F.array_join(kept, " "), r"\s+", " "), 1, 3000)).alias("digest"), F.element_at(F.concat(kept, F.array(F.lit(""))), 1).alias("title"))


def _any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _first(column, words):
    return "CASE " + " ".join(f"WHEN contains({column}, '{w}') THEN '{w}'" for w in words) + " END"


def _list(items):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _item(items, n):
    return f"({_list(items)})[CAST({n} % {len(items)} + 1 AS INTEGER)]"


_T = f"t AS (SELECT conv_id, turn, role, n, {_item(PHRASES, 'n')} || text AS said FROM (SELECT *, conv_id * 7 + turn * 3 AS n FROM conversations))"
_STAGE = "CASE " + " ".join(f"WHEN {_any('c', w)} THEN '{k}'" for k, w in rules.STAGES) + f" ELSE '{rules.STAGE_ELSE}' END"
_INJ = (
    f"i AS (SELECT conv_id, turn, n, CASE WHEN {_any('l', rules.TIME)} THEN 'time_keyword_matched' WHEN {_any('l', rules.PLACE)} THEN 'location_keyword_matched' WHEN contains(st, 'schedule') THEN 'schedule_stage' END AS time, "
    f"CASE WHEN {_any('l', rules.TREND)} THEN 'trending_keyword_matched' WHEN {_any('l', rules.FASHION)} THEN 'fashion_beauty_keyword_matched' WHEN contains(st, 'beauty') THEN 'beauty_stage' END AS trending, "
    f"CASE WHEN {_any('l', rules.PROFILE)} THEN 'profile_keyword_matched' WHEN contains(st, 'personal') THEN 'personal_stage' END AS profile "
    f"FROM (SELECT *, lower(said) AS l, lower({_item(['', 'Schedule', 'beauty_talk', 'personal'], 'n')}) AS st FROM t))"
)
_LANG = "CASE " + " ".join(f"WHEN regexp_matches(said, '[\\x{{{a}}}-\\x{{{b}}}]') THEN '{k}'" for k, a, b in SCRIPTS)
_LANG += " " + " ".join(f"WHEN {_any('lower(said)', w)} THEN '{k}'" for k, *w in GREETINGS) + " ELSE 'en' END"
_SIMPLE = "said"
for _w in rules.MODIFIERS:
    _SIMPLE = f"trim(replace({_SIMPLE}, '{_w}', ''))"

QUERIES = {f.__name__: f for f in (
    session_stage, route_decision, search_decision, search_enabled, injection_needs, injection_policy, correction_rules, language_tags, query_simplified, query_variants,
    document_classes, page_kind, time_parts, metrics_window, metrics_at_hour, json_arrays, json_repair, html_lines)}
ORACLE = {
    "session_stage": f"WITH {_T} SELECT conv_id, turn, {_STAGE} AS stage FROM (SELECT *, lower(role || ' ' || said) AS c FROM t)",
    "route_decision": f"""WITH {_T}, r AS (SELECT *, NOT {_any('trim(lower(said))', rules.NO_PLAN)} AS p, {_any('trim(lower(said))', rules.PLAN_SEARCH)} AS q FROM t)
SELECT conv_id, turn, CASE WHEN p AND NOT q AND n % 3 = 0 THEN false ELSE p END AS need_plan, CASE WHEN p AND NOT q THEN n % 5 = 0 ELSE q END AS need_search, CASE WHEN p AND NOT q THEN 'llm' ELSE 'pattern_match' END AS method FROM r""",
    "search_decision": f"""WITH {_T}, r AS (SELECT *, {_first('trim(lower(said))', rules.NO_SEARCH)} AS no, {_first('trim(lower(said))', rules.NEED_SEARCH)} AS yes FROM t)
SELECT conv_id, turn, CASE WHEN no IS NOT NULL THEN false WHEN yes IS NOT NULL THEN true WHEN length(said) <= 5 THEN false END AS need_search, coalesce(no, yes) AS word,
CASE WHEN no IS NOT NULL OR yes IS NOT NULL OR length(said) <= 5 THEN 'fast_rule' ELSE 'model' END AS method FROM r""",
    "search_enabled": f"WITH {_T} SELECT conv_id, turn, {_any('lower(said)', rules.LIVE)} AS live FROM t",
    "injection_needs": f"WITH {_T}, {_INJ} SELECT conv_id, turn, time, trending, profile FROM i",
    "injection_policy": f"""WITH {_T}, {_INJ} SELECT conv_id, turn, p = 'planner' OR (p = 'free_chat' AND time IS NOT NULL) AS time, p = 'planner' OR (p = 'free_chat' AND trending IS NOT NULL) AS trending,
p IN ('planner', 'free_chat') OR (p = 'knowledge' AND profile IS NOT NULL) AS profile, true AS intermediate FROM (SELECT *, {_item(PROMPTS, 'n')} AS p FROM i)""",
    "correction_rules": f"WITH {_T} SELECT conv_id, turn, h AS is_correction, CASE WHEN h THEN 0.7 ELSE 0.1 END::DOUBLE AS confidence, CASE WHEN h THEN said ELSE '' END AS content FROM (SELECT *, {_any('lower(said)', rules.CORRECTION)} AS h FROM t)",
    "language_tags": f"""WITH {_T}, l AS (SELECT *, {_LANG} AS lang FROM t), v AS (SELECT *, CASE WHEN lang = 'zh' AND {_any('lower(said)', rules.VARIANTS[0][1])} THEN 'zh-tw' WHEN lang = 'zh' AND {_any('lower(said)', rules.VARIANTS[1][1])} THEN 'zh-hk' ELSE lang END AS k FROM l)
SELECT conv_id, turn, CASE WHEN trim(said) <> '' THEN (MAP {{{", ".join(f"'{a}': '{b}'" for a, b in rules.TAGS.items())}}})[k] END AS tag FROM v""",
    "query_simplified": f"WITH {_T}, q AS (SELECT *, trim(regexp_replace({_SIMPLE}, '\\s+', ' ', 'g')) AS x FROM t) SELECT conv_id, turn, CASE WHEN length(x) < 2 THEN said ELSE x END AS query FROM q",
    "query_variants": f"""WITH {_T}, v AS (SELECT conv_id, turn, trim(said) AS q FROM t), a AS (SELECT conv_id, turn, [q, '什么是' || q, {", ".join(f"q || '{x}'" for x in rules.SUFFIXES)}] AS a FROM v)
SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, a[pos] AS query FROM (SELECT *, unnest(range(1, len(a) + 1)) AS pos FROM a)""",
    "document_classes": f"""WITH x AS (SELECT doc_id, lower({_item(['Patent', 'paper', 'web', 'Clinical', 'official', 'product', 'news', 'x'], 'doc_id')}) AS k, {_item(['', '产品 A', '论文 B', '专利 C', '新闻 D'], 'doc_id')} AS t,
substring(lower({_item(['', '', '临床 ', '医美 '], 'doc_id % 11')} || text), 1, 500) AS h, lower(source || {_item(['', '专利', 'PubMed', '官方'], 'doc_id % 7')}) AS s FROM documents)
SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'given' WHEN contains(k, 'patent') OR contains(s, '专利') THEN 'patent' WHEN contains(k, 'paper') OR contains(s, '论文') OR contains(s, 'pubmed') THEN 'academic' WHEN contains(k, 'clinical') OR contains(s, '临床') THEN 'clinical'
WHEN contains(k, 'official') OR contains(s, '官方') THEN 'official' WHEN contains(k, 'product') OR contains(s, '产品') THEN 'product' ELSE 'general' END AS authority,
CASE WHEN doc_id % 13 = 0 THEN 'given' WHEN contains(t, '产品') OR contains(k, 'product') THEN 'product' WHEN contains(t, '论文') OR contains(k, 'paper') THEN 'academic' WHEN contains(t, '专利') OR contains(k, 'patent') THEN 'patent'
WHEN contains(h, '临床') OR contains(k, 'clinical') THEN 'clinical' WHEN contains(t, '新闻') OR contains(k, 'news') THEN 'news' WHEN contains(h, '医美') OR contains(h, '美容') THEN 'medical_aesthetics' ELSE 'general' END AS category FROM x""",
    "page_kind": f"SELECT page_id, {' + '.join(f'contains(h, {w!r})::INTEGER' for w in rules.PAGE_SEARCH)} <= {' + '.join(f'contains(h, {w!r})::INTEGER' for w in rules.PAGE_CONTENT)} AS is_content FROM (SELECT page_id, substring(lower(html), 1, 1000) AS h FROM pages)",
    "time_parts": f"SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y年%m月%d日') AS day, CAST(hour(ts) AS VARCHAR) AS hour, ({_list(rules.WEEKDAYS)})[CAST(isodow(ts) AS INTEGER)] AS weekday, hour(ts) BETWEEN 6 AND 17 AS daytime FROM events",
    "metrics_window": "SELECT count(*) AS calls, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, round((1 - count_if(event_type = 'error') / count(*)) * 100, 4) AS success_rate, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'",
    "metrics_at_hour": "SELECT count(*) AS calls, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, count(DISTINCT user_id) AS users FROM events WHERE hour(ts) = 9",
    "json_arrays": """SELECT item_id, CASE WHEN item_id % 3 = 0 THEN coalesce(name, '') || '|' || coalesce(brand, '') || '|' || coalesce(size, 0) ELSE '' END AS items,
CASE WHEN item_id % 3 = 1 THEN array_to_string(list_filter([nullif(trim(coalesce(name, '')), ''), nullif(coalesce(brand, ''), ''), coalesce(size::VARCHAR, '')], lambda x: x IS NOT NULL), '|') ELSE '' END AS lines FROM items""",
    "json_repair": r"SELECT click_id, regexp_replace(props, '\s+', '', 'g') AS fixed FROM clicks",
    "html_lines": r"""WITH l AS (SELECT page_id, list_filter(list_transform(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: length(x) > 2 AND NOT starts_with(x, '#')) AS k FROM pages)
SELECT page_id, md5(substring(regexp_replace(array_to_string(k, ' '), '\s+', ' ', 'g'), 1, 3000)) AS digest, coalesce(k[1], '') AS title FROM l""",
}
