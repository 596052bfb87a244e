"""Text normalisation, headings, page furniture, citations and answer metrics as Spark columns.

Everything runs in the JVM except nfkc(), which has no built-in, and trigram_hashes(), which numpy
works out on bytes: both are Arrow UDFs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.grams import triple_hashes

# ---- fixed values: lists and patterns that results depend on ----
STOP_WORDS = (
    "the and for with from that this when then than are was were not all any can may will must into "
    "onto each other only also have has had been use used using before after while which what does "
    "should would there their they them its you your"
).split()
HEADING_STOP_WORDS = ["after", "before", "do", "for", "from", "how", "if", "in", "on", "the", "this", "to", "use", "when", "with"]
NUMBERED_HEADING = r"(?U)^(?:第\s*[\d一二三四五六七八九十百]+\s*[章節篇]|[\d一二三四五六七八九十]+(?:[.、．][\d一二三四五六七八九十]+)*[、.．)）])\s*\S+"
ACTION_HEADING = "^(?:變更|更改|設定|強制|註冊|開啟|關閉|使用|新增|刪除|移除|選擇|切換|建立|管理|封鎖|解除|還原|移動|複製|傳送|拍攝|錄製|連接|中斷|啟用|停用|將.*設為|如何)"
BULLET = r"(?U)^(?:[•·▪◦※*]|[-–—]|\d+[.、．)]|[（(]\d+[）)])"
LATIN_HEADING = r"^[A-Z][A-Za-z0-9+.-]*(?:\s+[A-Z][A-Za-z0-9+.-]*){1,4}$"
CLOSING = ["。", "，", "、", ",", ";", "；", "：", ":", "!", "！", "?", "？"]
CITATION = r"(?i)(?U)\s*\[\s*Data\s*:[^\]]*\]|\s*\[E\d+\]|\s*\[來源未映射\]"
CONTENT_KEYWORDS = {
    "diagnostic": ("diagnos", "symptom", "dtc", "trouble", "inspection", "check", "故障", "診斷", "檢查"),
    "procedure": ("removal", "installation", "procedure", "step", "caution", "warning", "拆卸", "安裝", "步驟"),
    "specification": ("specification", "service data", "torque", "tolerance", "標準", "扭力", "規格"),
}
GENERIC_TITLE_TERMS = ["如何", "可以", "使用", "設定", "功能", "裝置", "手機", "螢幕", "應用", "模式", "開啟", "關閉", "操作", "方法", "步驟", "事項", "資訊", "其他", "管理"]
COMPARISON = r"(?i)\b(?:compare[sd]?|comparing|comparison|differen(?:ce|ces|t)|differ|versus|vs\.?|both|in common)\b|what is common|比較|差異|差別|區別|異同|不同|相同|共同|兩者"
NOT_PROVIDED = ["手冊未提供", "手冊沒有提供", "請查閱手冊", "請查閱使用手冊", "資料未提供", "資料未說明"]
TRADITIONAL = "這個們來時為說國後發會對過還沒樣經開關門問間見話讓認請設車機長東書業電動網線圖頁點擊選單裝"
SIMPLIFIED = "这个们来时为说国后发会对过还没样经开关门问间见话让认请设车机长东书业电动网线图页点击选单装"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# ---- end of fixed values ----


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    # a single space stays as it is
    return F.trim(F.regexp_replace(text, r"(?U)[^\S ]\s*| \s+", " "))


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode normalisation form KC."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


# ---- passages ----
def without_references(text: Column, variant: Column | None = None) -> Column:
    """Without ids, page cross references and the variant's tag."""
    if variant is not None:
        text = F.when(F.coalesce(variant, F.lit("")) != "", F.replace(text, F.concat(F.lit("["), variant, F.lit("]")), F.lit(" "))).otherwise(text)
    text = F.when(F.contains(text, F.lit("INFOID:")), F.regexp_replace(text, r"(?U)INFOID:\s*\d+", " ")).otherwise(text)
    # word boundaries are slow to find: most texts hold nothing like a reference
    return let(text, lambda x: F.when(F.contains(x, F.lit("-")) & x.rlike(r"[A-Z]-\p{Nd}"), F.regexp_replace(x, r"(?U)\b[A-Z]{2,4}-\d+\b", " ")).otherwise(x))


def comparable(text: Column, variant: Column | None = None) -> Column:
    """Without ids and page cross references, lower case, white space collapsed."""
    return collapse(F.lower(without_references(text, variant)))


def _runs(text: Column, one: Callable[[Column, Column, Column], Column]) -> Column:
    """Distinct values of ``one`` for runs of three words over ASCII letters, digits and CJK."""
    words = F.regexp_extract_all(text, F.lit("([0-9a-z㐀-鿿]+)"), F.lit(1))
    at = lambda w: F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(let(words, lambda w: F.transform(at(w), lambda i: one(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))


def trigrams(text: Column) -> Column:
    """Distinct runs of three words."""
    return _runs(text, lambda a, b, c: F.concat_ws(" ", a, b, c))


def trigram_hashes(text: Column) -> Column:
    """64 bits for each of trigrams() of the text in lower case, in rising order, without the texts between; empty for null."""
    return triple_hashes(text)


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z][a-z0-9]{2,})"), F.lit(1))
    return F.array_except(found, F.lit(STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets (distinct arrays); null if both are empty."""
    same = F.size(F.array_intersect(a, b))
    return same / F.nullif(F.size(a) + F.size(b) - same, F.lit(0))


# ---- headings and page furniture ----
def is_section_heading(line: Column) -> Column:
    """Is a line a heading? Short lines only, so its parts are looked at in this order."""

    def of(value: Column) -> Column:
        words = F.split(value, " ")
        rest = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
        brand = F.exists(rest, lambda w: w.rlike("^.(?=.*[A-Z])(?=.*[a-z])") | w.rlike("^[^a-z]{2,5}$"))
        latin = value.rlike(LATIN_HEADING) & ~F.lower(words[0]).isin(HEADING_STOP_WORDS) & brand
        action = value.rlike(ACTION_HEADING) & ~value.rlike("[。，；;]")
        closed = value.rlike("[" + "".join(CLOSING) + "]$")
        plain = (value != "") & (F.length(value) <= 48) & ~value.rlike(BULLET) & ~closed
        return F.coalesce(plain & (value.rlike(NUMBERED_HEADING) | latin | action), F.lit(False))

    return let(collapse(line), of)


def strip_leading_folio(text: Column) -> Column:
    """Without an isolated number of 1-4 digits among the first three non-empty lines (not the first)."""

    def folio(full: Column) -> Column:
        value = lambda k: F.get(full, F.lit(k))["v"]
        number = lambda k: value(k).rlike(r"(?U)^\d{1,4}$")
        lone = lambda k: F.coalesce(number(k) & (~number(k - 1) | F.coalesce(~number(k + 1), F.lit(False))), F.lit(False))
        drop = F.when(lone(1), F.get(full, F.lit(1))["i"]).when(lone(2), F.get(full, F.lit(2))["i"]).otherwise(-1)
        return F.when(F.size(full) > 0, drop)

    lines = F.transform(lines_of(text), lambda v, i: F.struct(i.alias("i"), strip(v).alias("v"), v.alias("whole")))
    full = lambda cells: F.filter(cells, lambda x: x["v"] != "")
    less = lambda cells, drop: strip(F.array_join(F.transform(cells, lambda x: F.when(x["i"] == drop, F.lit("")).otherwise(x["whole"])), "\n"))
    return let(lines, lambda cells: let(folio(full(cells)), lambda drop: F.when(drop.isNull(), text).otherwise(less(cells, drop))))


def section_identifier(heading: Column, fallback: Column) -> Column:
    value = nfkc(F.when(F.coalesce(heading, F.lit("")) != "", heading).otherwise(fallback))
    value = F.regexp_replace(F.regexp_replace(value, "(?U)[^\\w㐀-鿿-]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(value, 1, 64), F.lit("")), fallback)


def safe_stem(name: Column) -> Column:
    """A file stem of letters, digits, '-' and '_'."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "(?U)[^\\p{L}\\p{N}_-]", "_")


def classify_content(text: Column) -> Column:
    """The class with most keyword occurrences; ties in the order of the table; none: general."""
    low = F.lower(text)
    scores = F.array(*[sum((occurrences(low, w) for w in words), F.lit(0)) for words in CONTENT_KEYWORDS.values()])
    best = F.array_max(scores)
    return F.when(best > 0, F.element_at(F.lit(list(CONTENT_KEYWORDS)), F.array_position(scores, best).cast("int"))).otherwise("general")


def is_table_of_contents(text: Column) -> Column:
    lines = F.filter(F.transform(lines_of(text), strip), lambda x: x != "")
    dotted = F.size(F.filter(lines, lambda x: x.rlike(r"(?U)\.{4,}\s*\d*\s*$")))
    title = F.exists(F.slice(lines, 1, 5), lambda x: F.lower(x).isin("contents", "table of contents", "目錄"))
    return (F.size(lines) == 0) | (title & (dotted / F.size(lines) >= 0.2))


# ---- scripts ----
def script_counts(text: Column) -> dict[str, Column]:
    n = lambda chars: F.length(F.regexp_replace(text, f"[^{chars}]", ""))
    return {"kana": n("぀-ヿ"), "hangul": n("가-힣"), "han": n("一-鿿"), "latin": n("A-Za-z"), "traditional": n(TRADITIONAL), "simplified": n(SIMPLIFIED)}


def language_of(c: dict[str, Column]) -> Column:
    """Rules over the summed counts of a document's pages."""
    return (
        F.when((c["hangul"] > F.greatest(c["han"], c["latin"]) * 0.5) & (c["hangul"] >= 20), "Korean")
        .when((c["kana"] >= 20) & (c["kana"] > c["han"] * 0.1), "Japanese")
        .when((c["han"] >= 20) & (c["han"] * 3 >= c["latin"]), F.when(c["traditional"] > c["simplified"], "Traditional Chinese").when(c["simplified"] > c["traditional"], "Simplified Chinese"))
        .when((c["latin"] >= 100) & (c["han"] + c["kana"] + c["hangul"] == 0), "English")
    )


def text_script(text: Column) -> Column:
    cjk = F.length(F.regexp_replace(text, "[^぀-ヿ㐀-䶿一-鿿가-힣豈-﫿]", ""))
    latin = F.size(F.regexp_extract_all(text, F.lit("([A-Za-z]{2,})"), F.lit(1)))
    return F.when(cjk + latin == 0, F.lit(None).cast("string")).when(cjk >= latin, "cjk").otherwise("latin")


def needs_rewrite(question: Column, script: Column) -> Column:
    return F.coalesce(text_script(question) != script, F.lit(False))


# ---- citations ----
def strip_citations(text: Column) -> Column:
    # both patterns look for white space from every character on: most texts have no bracket and none at their ends
    bare = let(F.coalesce(text, F.lit("")), lambda x: F.when(F.contains(x, F.lit("[")), F.regexp_replace(x, CITATION, "")).otherwise(x))
    ends = lambda x: F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))
    return let(bare, lambda x: F.when(ends(x).rlike(r"(?U)\s"), strip(x)).otherwise(x))


def cited_record_ids(text: Column) -> Column:
    """Numbers inside Sources (...) groups of data blocks."""
    blocks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)(?U)\[\s*Data\s*:([^\]]*)\]"), F.lit(1))
    groups = F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(r"(?i)(?U)Sources\s*\(([^)]*)\)"), F.lit(1))))
    parts = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), strip)))
    return F.array_distinct(F.filter(parts, lambda p: p.rlike(r"(?U)^\d+$")))


def cited_evidence_ids(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(E\d+)\]"), F.lit(1)))


# ---- answers ----
def normalize_answer(text: Column) -> Column:
    low = F.lower(strip_citations(text))
    bare = F.regexp_replace(low, r"[\p{P}$+<=>^`|~]", "")
    return collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def exact_match(pred: Column, truth: Column) -> Column:
    return (normalize_answer(pred) == normalize_answer(truth)).cast("double")


def char_f1(pred: Column, truth: Column) -> Column:
    """Multiset F1 over characters without spaces; both empty: 1."""
    bare = lambda x: F.replace(normalize_answer(x), F.lit(" "), F.lit(""))
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))

    def f1(p: Column, t: Column) -> Column:
        letters = F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
        shared = F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.least(times(p, c), times(t, c)))
        score = lambda same: F.when(same == 0, 0.0).otherwise(2 * (same / F.length(p)) * (same / F.length(t)) / (same / F.length(p) + same / F.length(t)))
        return F.when((F.length(p) == 0) | (F.length(t) == 0), (p == t).cast("double")).otherwise(let(shared, score))

    return let(bare(pred), lambda p: let(bare(truth), lambda t: f1(p, t)))


def answer_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalize_answer(text), F.lit("([a-z0-9]+|[㐀-䶿一-鿿])"), F.lit(1)))


def term_coverage(pred: Column, truth: Column) -> Column:
    want = answer_terms(truth)
    return F.when(F.size(want) == 0, 0.0).otherwise(F.size(F.array_intersect(want, answer_terms(pred))) / F.size(want))


def term_hit(pred: Column, truth: Column) -> Column:
    return (term_coverage(pred, truth) == 1.0).cast("double")


def best_over_truths(metric, pred: Column, truths: Column) -> Column:
    """The largest of a metric over several accepted answers; no answers is an error of the row (null)."""
    return F.array_max(F.transform(truths, lambda t: metric(pred, t)))


def combined_score(judge: Column, source: Column, share: Column, weight: float = 0.1) -> Column:
    """A judge's 0-1 score with a source bonus that never lowers it."""
    if not 0 <= weight <= 1:
        raise ValueError("the source weight must be between 0 and 1")
    return F.when(judge.isNull(), None).otherwise(F.round(F.when(source.isNull(), judge).otherwise(F.least(F.lit(1.0), judge + share * weight * source)), 4))


# ---- labels, grades, names ----
def evidence_page_label(pages: Column) -> Column:
    p = F.array_sort(F.array_distinct(pages))
    low, high = F.array_min(p), F.array_max(p)
    run = F.size(p) == high - low + 1
    text = F.when(low == high, low.cast("string")).when(run, F.concat_ws("-", low.cast("string"), high.cast("string"))).otherwise(F.array_join(F.transform(p, lambda x: x.cast("string")), ", "))
    return F.when(F.size(F.coalesce(pages, F.array().cast("array<int>"))) > 0, text)


def section_path_with_variant(path: Column, variant: Column) -> Column:
    """The tag goes after the document part of a path, unless it is there already."""
    tag = F.concat(F.lit("["), variant, F.lit("]"))
    head = F.split_part(path, F.lit(" > "), F.lit(1))
    rest = F.substr(path, F.length(head) + 1)
    return F.when((F.coalesce(variant, F.lit("")) == "") | F.contains(path, tag), path).otherwise(F.concat(head, F.lit(" "), tag, rest))


def with_variant_prefix(text: Column, variant: Column) -> Column:
    tag = F.concat(F.lit("["), variant, F.lit("]"))
    have = F.startswith(F.regexp_replace(text, r"(?U)^\s+", ""), tag)
    return F.when((F.coalesce(variant, F.lit("")) == "") | have, text).otherwise(F.concat(tag, F.lit(" "), text))


def parse_grade(value: Column) -> Column:
    """A legacy grade (number 0-2, label, 'n ...', percent of 2, true/false) on the 0-2 scale, else null."""
    text = strip(F.coalesce(value.cast("string"), F.lit("")))
    number = F.when(F.contains(text, F.lit("%")), F.try_divide(strip(F.split_part(text, F.lit("%"), F.lit(1))).try_cast("double"), F.lit(50))).otherwise(text.try_cast("double"))
    return (
        F.when(text.isin("正確", "全對", "true"), 2.0).when(text.isin("錯誤", "false"), 0.0).when(text == "部分對", 1.0)
        .when(text.rlike("^[012] "), F.substring(text, 1, 1).cast("double"))
        .when(~F.isnan(number) & number.between(0, 2), F.round(number, 4))
    )


def first_seen(*arrays: Column) -> Column:
    """Unique values over several arrays, in the order in which they come."""
    return F.array_distinct(F.concat(*arrays))


def name_list(text: Column) -> Column:
    """A comma list as trimmed unique names."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), strip), lambda x: x != ""))


def title_match(question: Column, title: Column) -> Column:
    """Does the title name a specific feature that the question names too?"""
    runs = lambda s: F.regexp_extract_all(s, F.lit("([㐀-鿿]+)"), F.lit(1))
    pairs = lambda s: F.array_distinct(F.flatten(F.transform(runs(s), lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))))
    latin = lambda s: F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit("([A-Za-z0-9]{2,})"), F.lit(1)), F.lower))
    bare = lambda s: F.regexp_replace(F.lower(s), r"(?U)[\W_]+", "")
    generic = F.lit(GENERIC_TITLE_TERMS)
    own, terms = F.array_except(pairs(title), generic), latin(title)
    whole = F.contains(bare(question), bare(title)) & ((F.size(own) > 0) | (F.size(terms) >= 2))
    shared = F.size(F.array_intersect(own, F.array_except(pairs(question), generic)))
    words = F.size(F.array_intersect(terms, latin(question)))
    return (F.size(pairs(title)) + F.size(terms) > 0) & (whole | (shared >= 2) | ((shared > 0) & (words > 0)))


def is_comparison(question: Column) -> Column:
    return question.rlike(COMPARISON)


def unsupported_answer(answer: Column, retrieved: Column) -> Column:
    """Says that the data lacks it, or cites records outside those retrieved."""
    low = F.lower(answer)
    says = F.exists(F.lit(NOT_PROVIDED), lambda p: F.contains(low, p))
    groups = F.regexp_extract_all(answer, F.lit(r"(?i)(?U)\[Data:\s*Sources\s*\(([^)]*)\)\]"), F.lit(1))
    cited = F.filter(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), strip))), lambda x: x != "")
    return says | ((F.size(groups) > 0) & (F.size(retrieved) > 0) & (F.size(F.array_except(cited, retrieved)) > 0))
