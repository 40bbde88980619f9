"""Template residue, filler and error-page text (problem 10).

Lines are masked (digits, hexadecimal ids, quoted names, file names). Documents in which every line is a notice by its
wording are mined first: their lines are routed to the leaves of a fixed-depth prefix tree (token count, then the
first tokens), lines of a leaf that are alike are merged to one template with a wildcard where they differ, and the
documents of each template are counted over the whole corpus. Then every line is judged by its wording and, where that
says nothing, by the mined template that it is like, so a notice in other words is found by its kin. Only lines of
notices are shuffled. The templates are the same for all partitions, and so are the verdicts. Apart from that, texts
are searched for unresolved slots.

A document is a case if a slot is unresolved or filler stands anywhere in it, or if nothing but notices (with page
navigation) stands in it. A document with content that only speaks of errors, placeholders or scripts is none.

Defined results: null, empty and blank texts and control strings give no row; long texts are read whole; repeated
rows count once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import spread

#: Levels of the prefix tree below the token count.
DEPTH = 4
#: Lines whose verdict a worker remembers; it starts anew beyond that, which changes no verdict.
MAX_REMEMBERED = 200_000
#: Share of equal tokens from which a line belongs to a template; its wildcards do not count as equal.
ALIKE = 0.75
#: Templates in a smaller share of all documents are not sent to the executors; their own lines are notices by wording.
LEAST_SHARE = 1e-5

_MASKS = [
    (re.compile(r"0x[0-9a-f]+|\b[0-9a-f]{12,}\b", re.I), "<id>"),
    (re.compile(r"\"[^\"\s]{1,40}\"|'[^'\s]{1,40}'"), "<q>"),
    (re.compile(r"\d+(?:[.,:-]\d+)*"), "<n>"),
]
_TOKENS = re.compile(r"<\w+>|[A-Za-z]+|[一-鿿]{1,2}|[^\sA-Za-z一-鿿]")

#: Words of filler text in Latin.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum".split()
)
LOREM_SHARE, LOREM_WORDS = 0.7, 5

#: Units that filler repeats, and keys typed at random.
_FILLER_UNIT = re.compile(
    r"(?:测试(?:数据|文本|文字|内容)?|文字|文本|内容|示例(?:文本|文字|内容)?(?:请替换)?|(?:此处|这里|此位置)(?:为|是)?(?:占位|填充)?(?:文字|文本|内容)|"
    r"占位(?:符|文字|文本|内容)?|(?:这里|此处|请)(?:输入|填写|填入|添加|放置)(?:正文|标题|描述|文字)?(?:内容|文字|文本)?|"
    r"dummy (?:content|text)(?: for layout(?: only)?)?|placeholder(?: text| content)?|(?:sample )?text goes here|sample text|(?:this is )?filler text|"
    r"replace this (?:paragraph|text|line|section)(?: with your own (?:copy|text|content|words))?|your (?:text|content|copy) (?:goes )?here|text goes here|insert text here|test|testing)[\s,，.。、;；!！]*",
    re.I,
)
_KEYS = re.compile(r"(?>qwerty|asdf|qwer|zxcv|hjkl|jkl;|lkj|asd|foo|bar|baz|testing|test|测试(?:数据)?|xxx++|aaa++|bbb++|abc|[;\s]++|\d++)++", re.I)

_SLOTS = re.compile(
    r"\{\{[^{}\n]*\}\}|\$\{[^{}\n]*\}|\$\[[^\[\]\n]*\]|\[\[[^\[\]\n]*\]\]|<%=?[^%\n]*%>|<<\s*[\w. ]{1,40}\s*>>|«[^»\n]+»"
    r"|\{(?:\d{1,2}|%?[sd]|[A-Za-z_][\w.]{0,40})\}|%[A-Z][A-Z_]{2,}%|%[A-Za-z]+(?:_[A-Za-z]+)+%|@@\w{1,40}@@|(?<!\w)__[A-Z][A-Z_]{1,40}__(?!\w)"
    r"|#(?:NAME\?|REF!|VALUE!|DIV/0!|N/A|NULL!|NUM!)|(?<![\w%])%[sd](?!\w)"
    r"|[\[【<（(〔{][ ]*(?:请|此处|这里|在此|待)(?:在此)?(?:处)?(?:填写|输入|填入|填|补充|插入|替换|选择|录入|定)[^\]】>）)〕}\n]*[\]】>）)〕}]"
    r"|\[(?:INSERT|ENTER|ADD|YOUR|TBD|TODO|PLACEHOLDER)\b[^\]\n]*\]|\[(?:Company|Product|Brand|Client|Customer|Your|Insert|Enter)\b[^\]\n]*\]"
    r"|<(?:your|insert|enter|please)\b[^>\n]*>|(?<!_)_{6,}(?!_)|\bTODO\s*[:：]|\bFIXME\b|\bLorem (?:text|ipsum)\b|示例[:：]\s*某|某某牌|X{4,}(?=有限|公司|牌|市|路|号|$)"
    r"|\bundefined undefined\b",
)
#: What a text with a slot has at least one of; most texts have none and are not searched further.
_SLOT_HINT = re.compile(r"[{\[<«%@#_【〔]|TODO|FIXME|Lorem|示例|某某|XXXX|undefined|[（(][ ]*[请此这在待]")
_LOREM_HINT = re.compile(r"\b(?:lorem|dolor|amet|tempor|magna|labore|veniam|nostrud|aliqua|elit|ipsum|sed|sit|adipiscing)\b", re.I)
_EMPTY_VALUE = re.compile(r"^[^:：\n]{1,30}[:：]\s*(?:undefined|null|NaN|None|TBD|TODO|XXX+|N/?A placeholder|\[object Object\])\s*$", re.I)

#: Page furniture that goes with a notice and is no content.
_NAVIGATION = re.compile(
    r"^(?:(?:返回(?:上一页|首页)?|首页|登录|注册|帮助|登出|搜索|菜单|刷新|重试|关闭|联系我们|menu|search|sign in|sign up|log ?in|home|back|help|"
    r"labels?|detail|details|retry|标签库|详情)[\s|/>·»‹›-]*)+$|^(?:©|\(c\)|copyright).*$|^(?:加载失败|加载中|loading)\W*$|^(?:nginx|openresty|apache|tomcat|iis|varnish|cloudflare)(?:[ /][\w.<>/ ()-]{0,60})?$",
    re.I,
)

#: Notices: each pattern says what failed or is demanded, and addresses whoever opened the page.
_NOTICE = [
    re.compile(p, re.I)
    for p in (
        # scripts and browsers
        r"(?:enable|turn on|activate|allow)\W+(?:java)?scripts?\b|(?:java)?scripts? (?:is|are|must be) (?:disabled|turned off|required|allowed|enabled)|without (?:java)?scripts? enabled",
        r"(?:需要|请|必须)(?:启用|开启|打开|允许)\s*(?:java ?script|脚本|cookie)|(?:未|没有)(?:开启|启用)(?:java ?script|脚本)|禁用(?:了)?(?:java ?script|脚本).{0,20}(?:无法|不能)|浏览器版本过低",
        r"checking your browser|检查您的浏览器|enable cookies|cookies? (?:are|is) (?:disabled|required)|browser is (?:not supported|out of date)|verify (?:that )?you are (?:a )?human|人机验证|请完成验证",
        # pages that are not there
        r"^\W*(?:error\W*)?<n>\W+not found|^(?:page|file) not found\W*$|(?:page|file|resource|url)\b.{0,30}(?:could not be (?:located|found)|cannot be found|was not found|no longer exists|has moved)",
        r"(?:您|你)?(?:访问|请求|查找|浏览)的.{0,12}(?:不存在|已被移除|已删除|找不到|无法找到)|页面(?:不存在|走丢了|找不到)",
        # servers
        r"^\W*(?:http )?(?:error|status)\W*<n>|internal server error|bad gateway|gateway (?:time-?out|did not respond)|service (?:is )?(?:temporarily )?unavailable|^too many requests|slow down and retry|try again later",
        r"服务器(?:开小差|错误|繁忙|异常|出错)|系统(?:繁忙|异常|维护|错误).{0,12}(?:稍后|请|再试)|请稍后(?:再试|重试)|数据库连接失败|(?:加载|请求|连接)(?:超时|失败)|网络(?:异常|错误)",
        # permission and session
        r"access (?:is )?denied|^forbidden|do not have permission|permission denied|unauthori[sz]ed access|^\W*<n> forbidden|please (?:log|sign) in to (?:view|continue)|session (?:has )?(?:expired|timed out)",
        r"权限不足|没有(?:访问)?权限|无权(?:访问|查看)|会话已(?:过期|失效)|登录(?:已)?(?:过期|失效|超时)|请(?:重新)?登录后",
        # gates, connections and works on the site
        r"you (?:have been|are|were) (?:temporarily )?(?:blocked|banned|rate.?limited)|unusual traffic|(?:site|page|website|server|connection)\b.{0,20}(?:can.?t|cannot|could not) be (?:reached|established|displayed|loaded)|(?:took|taking) too long to respond|\b(?:err|dns)_[a-z_]{4,}",
        r"error establishing a .{0,20}connection|(?:unable|failed|could not) (?:to )?connect to|connection (?:was )?(?:refused|reset|timed out)|request (?:could not be|cannot be|was not) (?:satisfied|processed|completed)|^\W*(?:<n>\W+)?(?:bad request|method not allowed|request time-?out|gone)\W*$",
        r"(?:site|page|website|service|system|server) (?:is )?(?:currently |temporarily )?(?:down|closed|offline|under(?:going)?)\b.{0,30}(?:maintenance|construction|upgrade)|(?:site|website) is (?:currently |temporarily )?(?:down|offline|unavailable)|if you are not (?:automatically )?redirected",
        r"(?:网站|站点|页面|系统|平台|服务)(?:正在|正)?(?:维护|升级|建设|施工)(?:中|升级)|无法(?:访问|连接|打开)(?:此|该|到|您)|(?:该|此)?(?:页面|网页|内容|文章|商品)(?:已过期|出错|已下架|已被?删除|无法(?:访问|打开|显示))|访问(?:过于)?频繁|您的(?:访问|请求|ip).{0,10}(?:被拒绝|被拦截|受限|异常)|没有自动跳转",
        # programs
        r"^traceback \(most recent|^file (?:<q>|\"[^\"]+\"), line <n>|^at [\w.$<>]+\([\w.<>: ]*\)|^(?:[\w.]+\.)?\w*(?:exception|error)\b\s*(?::.*)?$|^caused by:|sqlstate|query failed near|segmentation fault|fatal error|stack trace",
        r"unexpected error (?:has )?occurred|an error (?:has )?occurred|something went wrong|application error|^oops\b",
    )
]
#: What a notice has at least one of, in small letters; other lines are not matched with the patterns.
_NOTICE_HINTS = (
    "script 脚本 cookie 浏览器 browser human 验证 not+found could+not cannot can't can’t can+not no+longer+exists has+moved 不存在 移除 删除 找不到 走丢 error status gateway "
    "unavailable too+many+requests slow+down try+again 服务器 系统 稍后 数据库 超时 失败 网络 denied forbidden permission unauthori sign+in log+in expired timed+out 权限 无权 会话 登录 "
    "traceback exception caused+by sqlstate query+failed segmentation stack+trace went+wrong oops blocked banned limited unusual+traffic reached established displayed loaded respond "
    "err_ dns_ connect request method+not+allowed gone maintenance construction upgrade down closed offline redirected 维护 升级 建设 施工 无法 已过期 出错 已下架 频繁 您的 跳转"
)


@cache
def _hints() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for h in _NOTICE_HINTS.split():
        a.add_word(h.replace("+", " "), True)
    a.make_automaton()
    return a


ORDINARY, NOTICE, NAVIGATION, FILLER = range(4)


def masked(line: str) -> str:
    """``line`` with its variable parts masked."""
    for pattern, by in _MASKS:
        line = pattern.sub(by, line)
    return line


def classify(template: str) -> int:
    """What a message template is, by itself."""
    t = template.strip().lstrip(">•*- ").strip()
    if _NAVIGATION.match(t):
        return NAVIGATION
    low = t.lower()
    hinted = low.startswith(("at ", "file ")) or next(_hints().iter(low), None) is not None
    if hinted and any(p.search(t) for p in _NOTICE):
        return NOTICE
    return ORDINARY


def is_filler(line: str) -> bool:
    """Whether a line is filler: Latin dummy words, a repeated dummy unit or keys typed at random."""
    if _LOREM_HINT.search(line):
        words = re.findall(r"[A-Za-z]+", line)
        if len(words) >= LOREM_WORDS and sum(w.lower() in LOREM for w in words) >= LOREM_SHARE * len(words):
            return True
    t = line.strip()
    return bool(t) and (_units(t) or _KEYS.fullmatch(t) is not None and re.search(r"[^\W\d]{3,}|测试", t) is not None)


def _units(t: str) -> bool:
    """Whether ``t`` is made of dummy units alone."""
    at = 0
    while at < len(t):
        m = _FILLER_UNIT.match(t, at)
        if not m:
            return 6 <= at and t.startswith(t[at:])  # a last unit may be cut
        at = m.end()
    return True


def _leaf(tokens: list[str]) -> str:
    """Where the prefix tree leads ``tokens``."""
    return " ".join([str(len(tokens)), *tokens[:DEPTH]])


def _likeness(template: list[str], tokens: list[str]) -> float:
    return sum(a == b for a, b in zip(template, tokens)) / len(tokens)


def merged(lines: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """(template, documents) of the lines of one leaf, each with its number of documents; their order does not matter."""
    out: list[list] = []
    for tokens, n in sorted(lines, key=lambda x: (-x[1], x[0])):
        best = max(out, key=lambda t: _likeness(t[0], tokens), default=None)
        if best is not None and _likeness(best[0], tokens) >= ALIKE:
            best[0] = [a if a == b else WILDCARD for a, b in zip(best[0], tokens)]
            best[1] += n
        else:
            out.append([tokens, n])
    return [(t, n) for t, n in out]


WILDCARD = "<*>"


class TemplateTree:
    """The verdict of each line: by its wording, else by the mined templates of notices."""

    def __init__(self, templates: Iterable[str] = ()):
        self.leaves: dict[str, list[list[str]]] = {}
        for t in templates:
            tokens = t.split(" ")
            self.leaves.setdefault(_leaf(tokens), []).append(tokens)
        self.known: dict[str, int] = {}

    def verdict(self, line: str) -> int:
        m = masked(line)
        if len(m) > LONG_LINE:
            return self._verdict(m)
        if m not in self.known:
            if len(self.known) >= MAX_REMEMBERED:
                self.known.clear()
            self.known[m] = self._verdict(m)
        return self.known[m]

    def _verdict(self, m: str) -> int:
        v = classify(m)
        if v == ORDINARY and self.leaves:
            tokens = _TOKENS.findall(m)
            if any(_likeness(t, tokens) >= ALIKE for t in self.leaves.get(_leaf(tokens), ())):
                return NOTICE
        return v


#: Longer lines are judged by their sentences, each by itself.
LONG_LINE = 400
#: Ends of sentences, and where the lines of a program's trace begin if it stands in one line.
_PARTS = re.compile(r"(?<=[。！？!?；;])|(?<=[^\W\d]\.)\s|(?<=\d\.)\s|(?<=[)\]]\.)\s|\s(?=at [\w.$<>]{1,200}\(|File \"|Caused by:|Traceback \(|[\w.]{0,200}(?:Error|Exception)\b)")


def parts(line: str) -> Iterator[str]:
    """``line`` if it is short, else its sentences."""
    for part in _PARTS.split(line) if len(line) > LONG_LINE else (line,):
        if part.strip():
            yield part.strip()


def is_notice(text: str, tree: TemplateTree) -> bool:
    """Whether nothing but notices, with page navigation, stands in ``text``."""
    found = False
    for line in text.splitlines():
        for part in parts(line.strip()):
            v = tree.verdict(part)
            if v == ORDINARY:
                return False
            found |= v == NOTICE
    return found


def is_residue(text: str | None, tree: TemplateTree) -> bool:
    """Whether residue stands in place of content in ``text``."""
    if not text or not text.strip():
        return False
    if _SLOT_HINT.search(text) and _SLOTS.search(text):
        return True
    if any(is_filler(line) or _EMPTY_VALUE.match(line) for line in text.splitlines() if line.strip()):
        return True
    return is_notice(text, tree)


def mined_templates(texts: DataFrame) -> DataFrame:
    """(template, n): templates of the lines of all notices in ``texts`` (doc_id, text), with their documents."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree()
        for b in batches:
            n: Counter = Counter()
            for text in b.column(1).to_pylist():
                if text.strip() and is_notice(text, tree):
                    own = {masked(x) for line in text.splitlines() for x in parts(line.strip())}
                    n.update({" ".join(_TOKENS.findall(m)) for m in own if classify(m) == NOTICE})
            n.pop("", None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_leaf(k.split(" ")) for k in n], pa.string()), pa.array(list(n), pa.string()), pa.array(n.values(), pa.int64())],
                names=["leaf", "line", "n"],
            )

    def merge(leaf: pa.Table) -> pa.Table:
        out = merged([(t.split(" "), n) for t, n in zip(leaf["line"].to_pylist(), leaf["n"].to_pylist())])
        return pa.table({"template": pa.array([" ".join(t) for t, _ in out], pa.string()), "n": pa.array([n for _, n in out], pa.int64())})

    return (
        texts.mapInArrow(lines, "leaf string, line string, n long")
        .groupBy("leaf", "line")
        .agg(F.sum("n").alias("n"))
        .groupBy("leaf")
        .applyInArrow(merge, "template string, n long")
    )


def residue_documents(docs: DataFrame) -> DataFrame:
    """(doc_id): each document where residue stands in place of content."""

    texts = spread(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))
    least = LEAST_SHARE * texts.count()
    templates = tuple(r.template for r in mined_templates(texts).where(F.col("n") >= F.lit(least)).toLocalIterator())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = TemplateTree(templates)
        for b in batches:
            hit = [is_residue(t.as_py(), tree) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(hit, pa.bool_()))], names=["doc_id"])

    return texts.mapInArrow(find, "doc_id long").distinct()
