"""Rule tables: decisions, classes and tags by the first keyword list that hits; all in the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists of the rules, in the order in which they are tried.
STAGES = [
    ("MEDICAL_CONSULTATION_MODE", ["玻尿酸", "肉毒素", "水光针", "热玛吉", "超声刀", "激光", "光子嫩肤", "皮秒", "双眼皮", "隆鼻", "吸脂", "填充"]),
    ("SKINCARE_CONSULTATION_MODE", ["色斑", "雀斑", "晒斑", "黄褐斑", "痘痘", "痤疮", "皱纹", "细纹", "毛孔", "黑头", "敏感", "红血丝", "暗沉", "干燥", "出油", "黑眼圈"]),
    ("LEARNING_MODE", ["烟酰胺", "维c", "视黄醇", "a醇", "水杨酸", "果酸", "神经酰胺", "胶原蛋白", "胜肽"]),
    ("PRODUCT_CONSULTATION_MODE", ["产品", "推荐", "哪个好", "怎么选", "多少钱", "价格", "品牌"]),
    ("ADVICE_MODE", ["推荐", "建议", "怎么", "如何"]),
    ("CASUAL_CHAT_MODE", ["你好", "hi", "hello", "在吗", "谢谢"]),
]
STAGE_ELSE = "BEAUTY_CONSULTATION_MODE"
NO_PLAN = ["你好", "早上好", "晚安", "嗨", "hi", "hello", "在吗", "在不在", "在么", "谢谢", "OK", "好的", "收到", "明白", "知道", "感谢", "几点", "时间", "日期", "今天", "明天", "昨天", "后天",
           "天气", "温度", "晴", "雨", "雪", "风", "唱歌", "讲故事", "讲个笑话", "笑话", "计算", "1+1", "2*3"]
PLAN_SEARCH = ["最新", "现在", "今天热搜", "当前热搜", "热搜", "股价", "股票", "期货", "新闻", "发生了什么", "怎么回事", "刚发生了什么", "谁", "什么是", "怎么做", "如何", "怎样", "查一下", "搜索", "找一下"]
NO_SEARCH = ["你好", "早上好", "晚安", "嗨", "hi", "hello", "在吗", "在么", "谢谢", "感谢", "OK", "好的", "收到", "明白", "知道", "几点", "时间", "日期", "今天", "明天", "昨天", "后天",
             "天气", "温度", "晴", "雨", "雪", "风", "唱歌", "讲故事", "讲个笑话", "笑话", "计算", "1+1", "2*3", "加减乘除"]
NEED_SEARCH = ["最新", "现在", "今天热搜", "当前热搜", "股价", "股票", "期货", "新闻", "发生了什么", "怎么回事", "谁", "什么是", "怎么做", "如何"]
LIVE = ["今天", "昨天", "明天", "现在", "刚刚", "新闻", "最新", "最近", "实时", "天气", "温度", "多少度", "发生了什么", "怎么了", "现在几点", "当前时间", "今日", "此刻"]
TIME = ["时间", "几点", "今天", "明天", "昨天", "现在", "日期", "星期", "早上", "中午", "下午", "晚上", "凌晨", "什么时候", "when", "time", "today", "tomorrow", "now", "date"]
PLACE = ["位置", "在哪", "哪里", "地点", "地址", "城市", "省份", "这里", "那里", "附近", "本地", "地区", "where", "location", "place", "city", "area"]
TREND = ["热搜", "热点", "新闻", "热门", "流行", "趋势", "最新", "微博", "百度", "头条", "话题", "八卦", "娱乐", "hot", "trending", "news", "popular", "latest"]
FASHION = ["时尚", "美妆", "护肤", "穿搭", "化妆", "口红", "面膜", "衣服", "鞋子", "包包", "首饰", "发型", "造型", "vogue", "elle", "gq", "beauty", "makeup", "style"]
PROFILE = ["我", "我的", "我喜欢", "我想要", "推荐给我", "适合我", "记住", "偏好", "习惯", "历史", "my", "me", "i like", "recommend", "prefer"]
CORRECTION = ["不是", "不对", "错了", "纠正", "其实", "实际上", "正确的是", "应该是", "准确的是", "真实的是", "你错了", "你搞错了", "你讲错了", "你回答错了"]
VARIANTS = [("tw", ["台灣", "台", "中華民國", "灣", "裡", "後", "體", "發"]), ("hk", ["香港", "港", "嘅", "乜", "嘢", "係", "睇"])]
TAGS = {"zh": "zh-CN", "zh-tw": "zh-TW", "zh-hk": "zh-HK", "en": "en-US", "id": "id-ID", "ms": "ms-MY", "th": "th-TH", "vi": "vi-VN", "tl": "tl-PH", "km": "km-KH", "lo": "lo-LA", "my": "my-MM",
        "ta": "ta-SG", "ja": "ja-JP", "ko": "ko-KR", "fr": "fr-FR", "es": "es-ES", "pt": "pt-BR", "de": "de-DE", "ru": "ru-RU"}
MODIFIERS = ["如何", "怎样", "怎么", "什么", "为什么", "哪个", "哪里", "何时", "谁", "最", "非常", "特别", "十分", "比较", "相对"]
SUFFIXES = ["介绍", "定义", "含义", "原理", "作用", "好处", "方法", "步骤"]
PAGE_CONTENT = ["article", "post", "content", "正文", "详细", "介绍", "分析", "研究", "治疗", "方法", "原理", "效果", "注意事项", "文献", "论文"]
PAGE_SEARCH = ["search", "result", "results", "list", "item", "链接", "相关", "搜索结果"]
#: Authority: level, word in the source type, words in the source.
AUTHORITY = [("patent", "patent", ["专利"]), ("academic", "paper", ["论文", "pubmed"]), ("clinical", "clinical", ["临床"]), ("official", "official", ["官方"]), ("product", "product", ["产品"])]
#: Category: class, where its word is looked for, the word, word in the source type.
CATEGORY = [("product", "title", "产品", "product"), ("academic", "title", "论文", "paper"), ("patent", "title", "专利", "patent"), ("clinical", "head", "临床", "clinical"), ("news", "title", "新闻", "news")]
CARE = ["医美", "美容"]
WEEKDAYS = ["周一", "周二", "周三", "周四", "周五", "周六", "周日"]


def any_of(text: Column, words: list[str]) -> Column:
    """Whether one of the words occurs, as written; one pass over the text. False for null."""
    return F.coalesce(text.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def first_of(text: Column, words: list[str]) -> Column:
    """The first word of the list, in the list's order, that occurs; null without one."""
    return F.coalesce(*[F.when(text.contains(w), w) for w in words])


def stage(said: Column, context: Column) -> Column:
    """The conversation's stage by its words and what went before."""
    low = F.lower(F.concat_ws(" ", F.coalesce(context, F.lit("")), F.coalesce(said, F.lit(""))))
    return F.coalesce(*[F.when(any_of(low, words), name) for name, words in STAGES], F.lit(STAGE_ELSE))


def route(said: Column, plan: Column | None = None, search: Column | None = None) -> Column:
    """(need_plan, need_search, method): by word lists; where they leave it open, by a model's columns."""
    low = F.trim(F.lower(said))
    need_plan, need_search = ~any_of(low, NO_PLAN), any_of(low, PLAN_SEARCH)
    is_open = need_plan & ~need_search
    plan, search = (F.lit(None).cast("boolean") if c is None else c for c in (plan, search))
    return F.struct(
        F.when(is_open, F.coalesce(plan, need_plan)).otherwise(need_plan).alias("need_plan"),
        F.when(is_open, F.coalesce(search, need_search)).otherwise(need_search).alias("need_search"),
        F.when(is_open, "llm").otherwise("pattern_match").alias("method"),
    )


def search_need(said: Column) -> Column:
    """(need_search, word, method): ordered rules; short input needs none; else it is left to a model (null)."""
    low = F.trim(F.lower(said))
    no, yes = first_of(low, NO_SEARCH), first_of(low, NEED_SEARCH)
    short = F.length(said) <= 5
    return F.struct(
        F.when(no.isNotNull(), False).when(yes.isNotNull(), True).when(short, False).alias("need_search"),
        F.coalesce(no, yes).alias("word"),
        F.when(no.isNotNull() | yes.isNotNull() | short, "fast_rule").otherwise("model").alias("method"),
    )


def injection(said: Column, stage_name: Column) -> Column:
    """Reasons (time, trending, profile) for putting context into a prompt; null where there is none."""
    low, at = F.lower(said), F.lower(F.coalesce(stage_name, F.lit("")))
    time = F.when(any_of(low, TIME), "time_keyword_matched").when(any_of(low, PLACE), "location_keyword_matched").when(at.contains("schedule"), "schedule_stage")
    trend = F.when(any_of(low, TREND), "trending_keyword_matched").when(any_of(low, FASHION), "fashion_beauty_keyword_matched").when(at.contains("beauty"), "beauty_stage")
    profile = F.when(any_of(low, PROFILE), "profile_keyword_matched").when(at.contains("personal"), "personal_stage")
    return F.struct(time.alias("time"), trend.alias("trending"), profile.alias("profile"))


def injection_policy(reasons: Column, prompt: Column) -> Column:
    """(time, trending, profile, intermediate): what a prompt of the type gets."""
    chat, planner, known = prompt == "free_chat", prompt == "planner", prompt == "knowledge"
    return F.struct(
        (planner | (chat & reasons["time"].isNotNull())).alias("time"),
        (planner | (chat & reasons["trending"].isNotNull())).alias("trending"),
        (planner | chat | (known & reasons["profile"].isNotNull())).alias("profile"),
        F.lit(True).alias("intermediate"),
    )


def language_tag(lang: Column, text: Column, variant: Column | None = None) -> Column:
    """BCP-47 tag of a language code, with the region that the text or ``variant`` tells; null for blank text."""
    low = F.trim(F.lower(text))
    found = F.when(lang == "zh", F.coalesce(*[F.when(any_of(low, words), name) for name, words in VARIANTS]))
    chosen = found if variant is None else F.coalesce(variant, found)
    tags = F.create_map(*[F.lit(x) for pair in TAGS.items() for x in pair])
    tag = F.coalesce(F.try_element_at(tags, F.concat_ws("-", lang, chosen)), F.try_element_at(tags, lang))
    return F.when(F.trim(text) != "", tag)


def simplified(query: Column) -> Column:
    """Without modifiers, white space collapsed; the query itself if fewer than two characters are left."""
    short = reduce(lambda c, w: F.trim(F.replace(c, F.lit(w), F.lit(""))), MODIFIERS, query)
    short = F.trim(F.regexp_replace(short, r"\s+", " "))
    return F.when(F.length(short) < 2, query).otherwise(short)


def variants(query: Column) -> Column:
    """The query and what is asked about it, distinct, in order."""
    return F.array_distinct(F.array(query, F.concat(F.lit("什么是"), query), *[F.concat(query, F.lit(s)) for s in SUFFIXES]))


def authority_level(source_type: Column, source: Column) -> Column:
    kind, own = F.lower(source_type), F.lower(source)
    return F.coalesce(*[F.when(kind.contains(k) | any_of(own, ws), level) for level, k, ws in AUTHORITY], F.lit("general"))


def category(title: Column, content: Column, source_type: Column) -> Column:
    """Class by title, the first 500 characters and the source type."""
    where, kind = {"title": F.lower(title), "head": F.substring(F.lower(content), 1, 500)}, F.lower(source_type)
    rules = [F.when(where[w].contains(word) | kind.contains(k), name) for name, w, word, k in CATEGORY]
    return F.coalesce(*rules, F.when(any_of(where["head"], CARE), "medical_aesthetics"), F.lit("general"))


def is_content_page(html: Column) -> Column:
    """Whether at least as many content marks as listing marks occur in the first 1000 characters."""
    head = F.substring(F.lower(html), 1, 1000)
    count = lambda words: reduce(Column.__add__, [head.contains(w).cast("int") for w in words])
    return count(PAGE_SEARCH) <= count(PAGE_CONTENT)


def weekday(ts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.weekday(ts) + 1)


def json_array(text: Column, schema: str = "array<string>") -> Column:
    """What stands between the first [ and the last ] as an array; empty where that is no array."""
    raw = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    return F.coalesce(F.when(F.get_json_object(raw, "$").isNotNull(), F.from_json(raw, schema)), F.array().cast(schema))


def json_lines(text: Column, most: int = 5) -> Column:
    """Items of a list that is no JSON: quoted lines, and lines that begin with a number and a stop."""
    quotes = lambda c: F.regexp_replace(c, "^[\"']+|[\"']+$", "")
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    numbered = lambda x: quotes(F.regexp_replace(F.regexp_replace(x, r"^\d+\.", ""), r"^\s+|\s+$", ""))
    quoted = lambda x: x.rlike("^[\"'](?:.*[\"'])?$")
    items = F.transform(lines, lambda x: F.when(quoted(x), quotes(x)).when(x.rlike(r"^\d+\."), F.nullif(numbered(x), F.lit(""))))
    return F.slice(F.filter(items, lambda x: x.isNotNull()), 1, most)


def json_repaired(text: Column) -> Column:
    """Fences, comments, commas before a closing bracket and control characters dropped, and what stands around the JSON."""
    out = F.regexp_replace(text, r"(?m)^```(?:json)?\s*|```$", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?m)//.*?$", ""), r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(F.regexp_replace(out, r",\s*\}", "}"), r",\s*\]", "]")
    out = F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(out, r"^[^\[{]*", ""), r"[^\]}]*$", "")
