"""What is kept of users: sessions and styles folded from streams, prompts and profiles, lines of memory."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import decisions as rules
from lodestone.functions import prompts
from lodestone.operators import sessions as turns_of
from lodestone.plans import decisions
from lodestone.sources.tables import stream, table
from lodestone.streaming import sessions

KEEP = 3
#: A conversation belongs to one of so many users.
USERS = 97


def _sessions(s, d):
    """States of the clients' sessions over all clicks; an error ends a session."""
    fold = lambda batch: sessions.fold_sessions(batch, "client_id", "click_id", "value", F.col("kind") == "error", KEEP)
    merge = lambda old, new: sessions.merge_sessions(old, new, "client_id", KEEP)
    return sessions.folded_stream(stream(s, d, "clicks"), fold, merge, sessions.started(s, "sessions"))


def session_saved(s, d):
    """Every client's session as the stream has left it."""
    return _sessions(s, d).select("client_id", "cleared_at", "turns", F.round("total", 2).alias("total"), "created", "updated", F.array_join(F.col("last").cast("array<string>"), ",").alias("last"))


def session_get_or_create(s, d):
    """The session of every twentieth client: the saved one, or a new one without turns."""
    asked = table(s, d, "clients").where("client_id % 20 = 0").select("client_id").distinct()
    state = _sessions(s, d).where("turns > 0").select("client_id", "turns", "updated")
    return asked.join(state, "client_id", "left").select("client_id", F.col("turns").isNull().alias("is_new"), F.coalesce("turns", F.lit(0)).alias("turns"), "updated")


def _style(s, d):
    """Styles of the conversations' users from their turns, the marks as full-width ones."""
    wide = lambda batch: batch.where("role = 'user'").withColumn("text", F.translate("text", "!?", "！？"))
    fold = lambda batch: sessions.fold_styles(wide(batch), "conv_id", "turn", "text", prompts.EMOTIONS, prompts.PATTERNS)
    return sessions.folded_stream(stream(s, d, "conversations"), fold, lambda old, new: sessions.merge_styles(old, new, "conv_id"), sessions.started(s, "styles"))


def style_learnt(s, d):
    joined = {c: F.array_join(c, "|") for c in ("vocabulary", "patterns", "emotions")}
    return _style(s, d).select("conv_id", *[v.alias(k) for k, v in joined.items()])


def _profiles(s, d):
    """Profile text of every client: of a client's rows the one that was updated last."""
    last = F.max(F.struct("updated_at", "name", "city", "segment", "balance", "email")).alias("c")
    one = table(s, d, "clients").groupBy("client_id").agg(last)
    return one.select("client_id", prompts.profile_context(F.col("c.segment"), None, None, F.col("c.city"), None, None, None, F.round("c.balance", 0).cast("long"), F.col("c.email")).alias("profile"))


def profile_texts(s, d):
    return _profiles(s, d)


def _prompts(s, d):
    """A prompt for every conversation, with the profile of the client of that number and the style of every second."""
    asked = table(s, d, "conversations").select("conv_id").distinct()
    style = _style(s, d).where("conv_id % 2 = 0")
    found = asked.join(style, "conv_id", "left").join(_profiles(s, d).withColumnRenamed("client_id", "conv_id"), "conv_id", "left")
    language = F.when(F.col("conv_id") % 3 == 0, "calm")
    made = prompts.style_prompt(F.concat(F.lit("Answer "), F.col("conv_id").cast("string")), F.col("patterns").isNotNull(), F.col("profile"), language, F.col("vocabulary"), F.col("patterns"), F.col("emotions"))
    return found.select("conv_id", made.alias("p")).select("conv_id", "p.*")


def style_prompts(s, d):
    return _prompts(s, d)


def style_batch(s, d):
    """How many prompts were asked for, and how many have a style."""
    return _prompts(s, d).agg(F.count(F.lit(1)).alias("asked"), F.count_if("applied").alias("applied"))


def memory_lines(s, d):
    """For each user: of each conversation a summary of what is archived and its last three turns, of all that the last fifty lines."""
    turns = table(s, d, "conversations")
    said = F.when(F.col("role") == "user", F.concat(F.lit("用户说: "), "text")).otherwise(F.concat(F.lit("AI回复: "), F.substring("text", 1, 200)))
    last = turns_of.last_turns(turns, KEEP).where("text <> ''").select("conv_id", F.col("turn").alias("place"), said.alias("line"))
    summed = turns_of.archive(turns, KEEP).select("conv_id", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("会话摘要: "), F.col("turns").cast("string")).alias("line"))
    lines = last.union(summed).withColumn("user", F.col("conv_id") % USERS)
    newest = W.partitionBy("user").orderBy(F.desc("conv_id"), F.desc("place"), F.desc("line"))
    kept = lines.withColumn("n", F.row_number().over(newest)).where("n <= 50")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "line"))), lambda x: x["line"]), "\n")
    return kept.groupBy("user").agg(F.count(F.lit(1)).alias("lines"), F.md5(text).alias("digest"))


def injection_contexts(s, d):
    """What each turn's prompt gets: time, trends and profile where the rules ask for them, and the turn's number."""
    found = decisions._said(s, d).select("conv_id", "turn", rules.injection(F.col("said"), F.lit("")).alias("r"))
    profile = _profiles(s, d).withColumnRenamed("client_id", "conv_id")
    trends = table(s, d, "items").where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5)
    trends = trends.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "name"))), lambda x: x["name"]), " | ").alias("trends"))
    both = found.join(profile, "conv_id", "left").crossJoin(F.broadcast(trends))  # one row
    made = prompts.contexts(
        time_location=F.when(F.col("r.time").isNotNull(), F.concat(F.lit("at turn "), F.col("turn").cast("string"))),
        trending_topics=F.when(F.col("r.trending").isNotNull(), F.col("trends")),
        user_profile=F.when(F.col("r.profile").isNotNull(), F.col("profile")),
        intermediate_results=F.when(F.col("turn") > 0, F.col("turn").cast("string")),
    )
    text = F.array_join(F.transform(F.map_entries(made), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return both.select("conv_id", "turn", F.md5(text).alias("digest"), F.size(made).alias("parts"))


QUERIES = {f.__name__: f for f in (session_saved, session_get_or_create, style_learnt, profile_texts, style_prompts, style_batch, memory_lines, injection_contexts)}
_STATE = f"""e AS (SELECT *, coalesce(kind = 'error', false) AS clear FROM clicks WHERE client_id IS NOT NULL),
m AS (SELECT client_id, max(click_id) FILTER (clear) AS cleared_at FROM e GROUP BY client_id),
st AS (SELECT client_id, m.cleared_at, count(click_id) AS turns, round(coalesce(sum(value), 0), 2) AS total, min(click_id) AS created, max(click_id) AS updated, coalesce(array_to_string(list_slice(list(click_id ORDER BY click_id DESC), 1, {KEEP}), ','), '') AS last
FROM m LEFT JOIN (SELECT e.* FROM e JOIN m USING (client_id) WHERE NOT clear AND (cleared_at IS NULL OR click_id > cleared_at)) USING (client_id) GROUP BY ALL)"""
_STYLE = r"""u AS (SELECT conv_id, turn, translate(text, '!?', '！？') AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL AND conv_id IS NOT NULL),
w AS (SELECT conv_id, turn, unnest(l) AS w, unnest(range(len(l))) AS p FROM (SELECT conv_id, turn, list_slice(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''), 1, 3) AS l FROM u)),
f AS (SELECT conv_id, w, min({'t': turn, 'p': p}) AS o FROM w GROUP BY ALL),
v AS (SELECT conv_id, list_slice(list(w ORDER BY o, w), 1, 20) AS vocabulary FROM f GROUP BY conv_id),
sty AS (SELECT conv_id, coalesce(v.vocabulary, []) AS vocabulary, CASE WHEN bool_or(text LIKE '%？%' OR text LIKE '%吗%') THEN ['疑问'] ELSE [] END AS patterns, CASE WHEN bool_or(text LIKE '%！%' OR text LIKE '%哇%') THEN ['感叹'] ELSE [] END AS emotions
FROM u LEFT JOIN v USING (conv_id) GROUP BY conv_id, v.vocabulary)"""
_PROFILE = f"""lc AS (SELECT client_id, max({{'u': updated_at, 'name': name, 'city': city, 'segment': segment, 'balance': balance, 'email': email}}) AS c FROM clients GROUP BY client_id),
pr AS (SELECT client_id, coalesce(nullif(concat_ws('；', CASE WHEN c.segment <> '' THEN '用户偏好: ' || c.segment END, CASE WHEN c.city <> '' THEN '生活方式: ' || c.city END, '消费习惯: ' || round(c.balance, 0)::BIGINT, CASE WHEN c.email <> '' THEN '娱乐偏好: ' || c.email END), ''), '{prompts.NO_PROFILE}') AS profile FROM lc)"""
_PROMPT = f"""{_STYLE}, {_PROFILE}, q AS (SELECT conv_id, s.patterns IS NOT NULL AS applied, 'Answer ' || conv_id AS base, profile,
concat_ws(chr(10), CASE WHEN conv_id % 3 = 0 THEN '【语言风格】calm' END, '【用词偏好】可以使用: ' || nullif(array_to_string(vocabulary[1:5], ', '), ''), '【句式偏好】' || nullif(array_to_string(patterns, ', '), ''), '【情感表达】' || nullif(array_to_string(emotions, ', '), '')) AS guide
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT * FROM sty WHERE conv_id % 2 = 0) s USING (conv_id) LEFT JOIN pr ON pr.client_id = conv_id),
ps AS (SELECT conv_id, applied, CASE WHEN applied THEN concat_ws(chr(10) || chr(10), '【用户画像背景】' || profile, base, '【回复风格指导】' || nullif(guide, '')) ELSE base END AS prompt FROM q)"""
ORACLE = {
    "session_saved": f"WITH {_STATE} SELECT * FROM st",
    "session_get_or_create": f"WITH {_STATE} SELECT client_id, turns IS NULL AS is_new, coalesce(turns, 0) AS turns, updated FROM (SELECT DISTINCT client_id FROM clients WHERE client_id % 20 = 0) LEFT JOIN (SELECT * FROM st WHERE turns > 0) USING (client_id)",
    "style_learnt": f"WITH {_STYLE} SELECT conv_id, array_to_string(vocabulary, '|') AS vocabulary, array_to_string(patterns, '|') AS patterns, array_to_string(emotions, '|') AS emotions FROM sty",
    "profile_texts": f"WITH {_PROFILE} SELECT * FROM pr",
    "style_prompts": f"WITH {_PROMPT} SELECT * FROM ps",
    "style_batch": f"WITH {_PROMPT} SELECT count(*) AS asked, count_if(applied)::BIGINT AS applied FROM ps",
    "memory_lines": f"""WITH t AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations),
l AS (SELECT conv_id, turn AS place, CASE WHEN role = 'user' THEN '用户说: ' || text ELSE 'AI回复: ' || substring(text, 1, 200) END AS line FROM t WHERE recency <= {KEEP} AND text <> ''
UNION ALL SELECT conv_id, -1, '会话摘要: ' || count(*) FROM t WHERE turn <= last - {KEEP} GROUP BY conv_id),
n AS (SELECT *, conv_id % {USERS} AS user, row_number() OVER (PARTITION BY conv_id % {USERS} ORDER BY conv_id DESC, place DESC, line DESC) AS n FROM l)
SELECT user, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY n DESC)) AS digest FROM n WHERE n <= 50 GROUP BY user""",
    "injection_contexts": f"""WITH {decisions._T}, {decisions._INJ.replace("lower(" + decisions._item(['', 'Schedule', 'beauty_talk', 'personal'], 'n') + ")", "''")}, {_PROFILE},
tr AS (SELECT string_agg(name, ' | ' ORDER BY n DESC, name) AS trends FROM (SELECT name, count(*) AS n FROM items WHERE name IS NOT NULL GROUP BY name ORDER BY n DESC, name LIMIT 5)),
x AS (SELECT conv_id, turn, list_filter([CASE WHEN time IS NOT NULL THEN 'time_location=at turn ' || turn END, CASE WHEN trending IS NOT NULL THEN 'trending_topics=' || trends END, CASE WHEN i.profile IS NOT NULL THEN 'user_profile=' || pr.profile END,
CASE WHEN turn > 0 THEN 'intermediate_results=' || turn END], lambda v: v IS NOT NULL) AS l FROM i LEFT JOIN pr ON pr.client_id = conv_id, tr)
SELECT conv_id, turn, md5(array_to_string(l, ';')) AS digest, len(l)::INTEGER AS parts FROM x""",
}
