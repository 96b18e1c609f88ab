"""What a rewritten query must keep: anchors, organisations, constraints and their comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.text import ALIASES, LOCATOR, canonical_text, let, quote, reporting_periods, to_halfwidth, where_cjk

# Anchor patterns by kind.
ANCHORS = {
    "locator": LOCATOR,
    "date": (
        r"(?i)(?<!\d)(?:19|20)\d{2}\s*年\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?|(?<!\d)(?:19|20)\d{2}\s*年?\s*(?:第\s*)?[一二三四1-4]\s*季度"
        r"|(?<!\d)(?:19|20)\d{2}\s*年?\s*(?:上半年|下半年|全年|年度)|(?<!\d)(?:19|20)\d{2}\s*年?\s*[-－—至到/]\s*(?:19|20)\d{2}\s*年?"
        r"|(?<!\d)(?:\d{2}|(?:19|20)\d{2})\s*H[12]|(?:\d{2}|(?:19|20)\d{2})?\s*Q[1-4]|(?<!\d)(?:19|20)\d{2}\s*年?(?!\d)"
    ),
    "relative_time": r"(?:未来|过去|近)\s*[一二三四五六七八九十两\d]+\s*(?:年|个月|季度)|今年|去年|明年|本年度|上年度|本季度|上季度|上半年|下半年|(?:第\s*)?[一二三四1-4]\s*季度",
    "number_with_unit": r"(?i)[-+]?\d+(?:\.\d+)?\s*(?:%|％|百万元|百万美元|亿美元|美元|亿元|万元|元|倍|万吨|万千瓦|亿千瓦时|千瓦时|兆瓦时|GW|MW|kW|x)",
    "number": r"(?<![A-Za-z\d])[-+]?\d+(?:\.\d+)?",
    "code": r"(?i)(?<!\d)\d{6}(?:\.(?:SH|SZ|BJ))?(?!\d)",
    "negation": "没有|并未|未能|未曾|未发生|未提供|未披露|未包含|不能|不含|不包括|(?<!是)不是|不高于|不低于|不超过|不少于|不支持|不考虑|不计算|无法|无需",
    "canonical_term": "(?i)归母净利润|扣非归母净利润|营业收入|营业成本|每股收益|市盈率|市净率|现金流|装机容量|发电量|上网电价|利用小时|煤价|分红|股息率|估值|毛利率|净利率|资产负债率|同比|环比|预测|实际|截至|分别",
}
# Fixed value: quoted terms.
QUOTED = "[“‘\"']([^”’\"']{2,40})[”’\"']"
# Fixed value: organisation names by suffix.
ORGANIZATION = r"[\x{4e00}-\x{9fff}A-Za-z0-9·]{1,24}?(?:股份有限公司|有限责任公司|集团有限公司|股份|集团|电力|能源|银行|证券|科技|公司)"
# Fixed value: words before a name that do not belong to it.
LEAD_IN = (
    "^(?:(?:这份|该|本)?(?:研报|研究报告|报告)(?:中|里)?(?:对|关于|认为|觉得)?|帮我查询|帮我查|想知道|请问|关于|根据|对|"
    "关键财务与估值指标表|查询|查找|找出|获取|比较|说明|解释|分析|介绍|列出|预计|以及|请|先|再|和|与|"
    "(?:哪些|什么|具体)?(?:数据|信息|证据)?(?:来|用于)?支持)+"
)
# Names that stand for no one organisation.
GENERIC_NAMES = ["上市公司", "该公司", "本公司", "公司", "电力", "能源", "银行", "证券", "推荐公司", "目标公司"]
# Persons at places, and named products.
AT_PLACE = r"(?:^|[，。；！？\s])([\x{4e00}-\x{9fff}A-Za-z·]{2,12})在([\x{4e00}-\x{9fff}A-Za-z·]{2,12}?)(?:负责|工作|任职|担任|居住)"
NAMED_THING = r"(?:项目|产品|设备|型号)\s*[A-Za-z][A-Za-z0-9_-]*"
# Metrics, and fields of statements.
METRICS = ["经营活动现金流", "现金流", "累计装机容量", "新增装机容量", "装机容量", "发电量", "上网电量", "上网电价", "利用小时", "煤价", "分红", "估值", "同比", "环比", "预测", "实际", "截至", "分别"]
STATEMENT_FIELDS = [
    "企业自由现金流", "净利润", "净利率", "净资产", "利润总额", "固定资产", "基本每股收益", "存货", "存货净额", "存货账面余额", "市净率", "市盈率", "应收票据及账款", "归母净利润", "总负债", "总资产",
    "所有者权益", "扣非归母净利润", "每股收益", "每股红利", "毛利率", "研发费用", "研发费用率", "稀释每股收益", "管理费用", "管理费用率", "经营活动现金流量净额", "经营现金流", "股东权益", "股息率",
    "股权自由现金流", "营业利润", "营业成本", "营业收入", "负债总额", "财务费用", "财务费用率", "财务费用金额", "货币资金", "资产总额", "资产负债率", "销售费用", "销售费用率", "预付账款",
]
# Lines of business.
BUSINESS_SCOPES = ["光伏", "煤电", "气电", "火电", "水电", "风电"]
# Comparison words.
OPERATORS = {"不高于": "<=", "不超过": "<=", "至多": "<=", "小于等于": "<=", "不低于": ">=", "不少于": ">=", "至少": ">=", "大于等于": ">=", "大于": ">", "高于": ">", "超过": ">", "小于": "<", "低于": "<", "等于": "="}
# Words that a rewrite must not lose.
HARD_TERMS = ("不含", "不包括", "不考虑", "实际", "预测", "累计", "新增", "单季度", "全年", "扣非")


#: Anchors of which every match holds a Chinese character.
CHINESE = {ANCHORS[k] for k in ("locator", "relative_time", "negation", "canonical_term")}


def _any(words) -> str:
    """Pattern of any of the words, longest first."""
    return "|".join(quote(w) for w in sorted(set(words), key=lambda w: (-len(w), w)))


def _found(text: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if pattern in CHINESE:
        found = where_cjk(text, found, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def organizations(c: Column, known: list[str] | None = None) -> Column:
    """Organisation names: exactly the known ones where given (longest first), else names by suffix."""
    text = F.coalesce(c, F.lit(""))
    if known is not None:
        if not known:
            return F.array().cast("array<string>")
        return F.array_distinct(F.regexp_extract_all(text, F.lit(_any(known)), F.lit(0)))
    # A field name that ends like a company is none: known fields are masked, then times.
    fields = [n for k, names in ALIASES.items() for n in (k, *names) if not n.isascii()]
    masked = F.regexp_replace(text, _any(fields), " ")
    masked = F.regexp_replace(F.regexp_replace(masked, ANCHORS["date"], " "), ANCHORS["relative_time"], " ")
    # Every name ends in Chinese, so a text without has none.
    names = F.transform(F.regexp_extract_all(masked, F.lit(ORGANIZATION), F.lit(0)), lambda x: F.trim(F.regexp_replace(F.trim(x), LEAD_IN, "")))
    generic = F.array(*[F.lit(n) for n in GENERIC_NAMES])
    kept = F.array_distinct(F.filter(names, lambda x: (x != "") & F.contains(text, x) & ~F.array_contains(generic, x) & ~F.endswith(x, F.lit("的公司")) & (F.length(x) <= 20)))
    return where_cjk(text, kept, F.array().cast("array<string>"))


def named_terms(c: Column) -> Column:
    """Persons and places of "A at B works" clauses, and named projects, products, devices and models."""
    text = F.coalesce(c, F.lit(""))
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(AT_PLACE), F.lit(1)), F.regexp_extract_all(text, F.lit(AT_PLACE), F.lit(2)), lambda a, b: F.array(a, b))
    return where_cjk(text, F.array_distinct(F.concat(F.flatten(pairs), F.regexp_extract_all(text, F.lit(NAMED_THING), F.lit(0)))), F.array().cast("array<string>"))


def metric_terms(c: Column) -> Column:
    """Metrics and statement fields of the canonical text, the longest name at a place."""
    pattern = _any(METRICS + STATEMENT_FIELDS)
    return F.array_distinct(let(canonical_text(c), lambda x: where_cjk(x, F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))))


def anchors(c: Column, known: list[str] | None = None) -> Column:
    """Array of (kind, text, start): anchors that a rewrite must keep, start in characters from 0 (-1: not as written), each text of a kind once."""
    text = F.coalesce(c, F.lit(""))
    parts = [_tagged(k, _found(text, ANCHORS[k])) for k in ANCHORS]
    parts.append(_tagged("organization", organizations(c, known)))
    parts.append(_tagged("named", named_terms(c)))
    parts.append(_tagged("metric", metric_terms(c)))
    parts.append(_tagged("quoted", F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda x: F.trim(x)), lambda x: x != ""))))
    return F.transform(F.concat(*parts), lambda a: F.struct(a["kind"].alias("kind"), a["text"].alias("text"), (F.instr(text, a["text"]) - 1).alias("start")))


def risky_terms(c: Column, known: list[str] | None = None) -> Column:
    """Exact conditions that a rewrite must not add: locators, dates, numbers, codes, negations, names and lines of business."""
    text = F.translate(to_halfwidth(F.coalesce(c, F.lit(""))), "−—", "--")
    found = [_found(text, ANCHORS[k]) for k in ("locator", "date", "number_with_unit", "number", "code", "negation")]
    scopes = F.filter(F.array(*[F.lit(b) for b in BUSINESS_SCOPES]), lambda b: F.contains(text, b))
    return F.array_distinct(F.concat(*found, organizations(text, known), named_terms(text), scopes))


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))


def _texts(items: Column) -> Column:
    return F.array_distinct(F.transform(items, lambda a: a["text"]))


def _operators(c: Column) -> Column:
    pattern = "|".join(sorted(OPERATORS, key=len, reverse=True))
    names = F.create_map(*[F.lit(x) for kv in OPERATORS.items() for x in kv])
    return F.concat(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda x: F.element_at(names, x)), F.regexp_extract_all(c, F.lit("[<>]=?|(?<![<>])="), F.lit(0)))


def _subjects_swapped(original: Column, candidate: Column, known: list[str] | None) -> Column:
    """One organisation on either side of the comparison, and the right one now stands first."""
    left = canonical_text(F.get(F.split(F.regexp_replace(original, "同比|环比|比例|比较", ""), "比", 2), F.lit(0)))
    names = F.transform(organizations(original, known), lambda n: canonical_text(n))
    sides = F.struct(F.filter(names, lambda n: F.contains(left, n)).alias("a"), F.filter(names, lambda n: ~F.contains(left, n)).alias("b"), canonical_text(candidate).alias("now"))
    one = lambda s: (F.size(s["a"]) == 1) & (F.size(s["b"]) == 1)
    return let(sides, lambda s: F.when(one(s), F.instr(s["now"], F.get(s["a"], F.lit(0))) > F.instr(s["now"], F.get(s["b"], F.lit(0)))).otherwise(False))


def rewrite_check(original: Column, candidate: Column, known: list[str] | None = None) -> Column:
    """(valid, missing_anchors, added_risky_terms, conflicts) of a rewritten query."""
    required = _texts(anchors(original, known=known))
    held = canonical_text(candidate)
    missing = F.array_sort(F.filter(required, lambda a: ~F.contains(held, canonical_text(a))))
    own = F.transform(risky_terms(original, known), lambda a: canonical_text(a))
    added = F.filter(risky_terms(candidate, known), lambda a: ~F.array_contains(own, canonical_text(a)))
    periods = reporting_periods(original)
    added = F.array_sort(F.filter(added, lambda a: ~(a.rlike("^(?:" + ANCHORS["date"] + ")$") & ~a.rlike("月|日") & (F.size(reporting_periods(a)) > 0) & (F.size(F.array_except(reporting_periods(a), periods)) == 0))))
    forecast = r"(?i)(?:19|20)\d{2}E(?![A-Za-z0-9])"
    years = lambda c: F.regexp_extract_all(c, F.lit(r"(?:19|20)\d{2}"), F.lit(0))
    compared = original.rlike("(?<![同环])比(?![较例重率])")
    reordered = compared & (F.size(F.array_distinct(years(original))) >= 2) & (years(original) != years(candidate))
    conflicts = [
        F.when(_operators(original) != _operators(candidate), F.lit("comparison_operator_changed")),
        F.when(reordered, F.lit("comparison_arguments_changed")),
        F.when(compared & _subjects_swapped(original, candidate, known), F.lit("comparison_subjects_changed")),
        *[F.when(F.contains(original, F.lit(t)) & ~F.contains(candidate, F.lit(t)) & ~(F.lit(t == "预测") & candidate.rlike(forecast)), F.lit(f"constraint_dropped:{t}")) for t in HARD_TERMS],
        F.when(original.rlike(forecast) & ~candidate.rlike(forecast) & ~F.contains(candidate, F.lit("预测")), F.lit("forecast_basis_dropped")),
    ]
    found = F.filter(F.array(*conflicts), lambda x: x.isNotNull())
    parts = F.struct(missing.alias("missing_anchors"), added.alias("added_risky_terms"), found.alias("conflicts"))
    return let(
        parts,
        lambda p: F.struct(
            ((F.trim(candidate) != "") & (F.size(p["missing_anchors"]) == 0) & (F.size(p["added_risky_terms"]) == 0) & (F.size(p["conflicts"]) == 0)).alias("valid"),
            p["missing_anchors"].alias("missing_anchors"), p["added_risky_terms"].alias("added_risky_terms"), p["conflicts"].alias("conflicts"),
        ),
    )
