from labelloom.llm import residue
from labelloom.llm.residue import WILDCARD, TemplateTree, is_residue, merged, mined_templates, residue_documents

CASES = [
    "净含量：{{ net_weight }}\n产地：甲", "本产品由[此处填写产地]生产", "Net weight ${origin}, best before 3 days", "地址：<请输入地址>", "规格：____________", "产品名称：XXXX有限公司",
    "404 Not Found\nThe requested label page could not be located on this server.", "请启用 JavaScript 才能正常浏览", "返回上一页\n您访问的标签页面不存在或已被移除，请返回首页。", "此处为占位文字此处为占位文字",
    "产品介绍\nlorem dolor sit amet sed magna elit tempor\n产地：甲", "asdf;lkj\nqwerty\n测试数据5", "HTTP Error 502 - gateway did not respond in time. Ref 1-2.", "Traceback (most recent call last):\n  File \"a_1.py\", line 3, in build\nKeyError: 'x'",
    "系统繁忙，请稍后再试。错误代码：E7", "CHECKING YOUR BROWSER BEFORE OPENING THE LABEL VIEWER.", "产地：undefined", "Replace this paragraph with your own copy. ", "测试测试测试测",
    "Sorry, you have been blocked", "This site can’t be reached", "网站正在维护中", "Error establishing a database connection", "Dear %recipient_name%, your label is ready.",
    "502 Bad Gateway\nnginx", "ERR_CONNECTION_TIMED_OUT\nexample took too long to respond.", "【请填写" + "产地、生产日期、批号和" * 9 + "其余项目】", "无法访问此网站", "The website is currently down for scheduled maintenance.",
]
OTHERS = [
    None, "", "  \n", "<|endoftext|>", "产地：甲 <|endoftext|> 商标：乙", "模板中的占位符在送审前已由标签组全部替换，抽查3处未见遗漏。", "导出时系统曾返回404，编辑重启服务后已恢复，结果重新比对无误。",
    "The export job logged error 404 12 times last month, and all 3 labels were rebuilt and rechecked.", "包装底部预留的“请填写生产日期”方框属于印刷内容，须原样保留。", "The table lists energy at 404 kJ and protein at 2 g per serving.",
    "The viewer works with and without JavaScript, so the verification test covered both.", "Page not numbered: the back panel has no printed page mark, which is correct.", "净含量：100 g\n贮存条件：常温", "样盒尺寸为10×2×3厘米（见图），净重5%",
    "The blocked label was reprinted after the site visit.", "维护记录一栏空白，已补签。",
    "普通的一段文字。\n404 Not Found 是测试中引用的一行说明。",
]


def test_cases():
    tree = TemplateTree()
    assert [t for t in CASES if not is_residue(t, tree)] == []
    assert [t for t in OTHERS if is_residue(t, tree)] == []


def test_hints_hide_no_notice():
    lines = [residue.masked(x.strip()) for t in CASES + OTHERS if t for x in t.splitlines()]
    assert all(residue.classify(x) in (residue.NOTICE, residue.NAVIGATION) for x in lines if any(p.search(x) for p in residue._NOTICE))


def test_verdicts_do_not_depend_on_order():
    one, other = TemplateTree(), TemplateTree()
    texts = [t for t in CASES + OTHERS if t]
    assert [is_residue(t, one) for t in texts] == [is_residue(t, other) for t in reversed(texts)][::-1]


def test_operator(spark):
    data = [(n, t, "x") for n, t in enumerate(CASES + OTHERS)] + [(0, CASES[0], "x"), (None, CASES[0], "x"), (999, "正文。" * 30000 + "{{slot}}", "x")]
    out = residue_documents(spark.createDataFrame(data, "doc_id long, text string, hit string"))
    assert {r.doc_id for r in out.collect()} == {*range(len(CASES)), 999} and out.count() == len(CASES) + 1
    assert residue_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_templates_are_mined(spark):
    """Notices in other words are found by their kin in other documents, and spaces are part of a line."""
    known = [f"The requested label page was not found on {h} server." for h in ("this", "our", "any")]
    other = "The requested label page was not readable on this server."
    data = [(n, t) for n, t in enumerate([*known, *known, other, other + "\n产地：甲", "The requested label has three pages on this side of the box."])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert [(r.template, r.n) for r in mined_templates(df).collect()] == [(f"The requested label page was not found on {WILDCARD} server .", 6)]
    assert not is_residue(other, TemplateTree())
    assert {r.doc_id for r in residue_documents(df).collect()} == set(range(7))
    for order in (1, -1):
        tree = TemplateTree()
        assert {t: is_residue(t, tree) for t in ["页面 不存在", "页面不存在"][::order]} == {"页面 不存在": False, "页面不存在": True}
    lines = [(f"a b c d e f g {k}".split(), k) for k in range(1, 5)]
    assert merged(lines) == merged(lines[::-1]) == [("a b c d e f g <*>".split(), 10)]


def test_long_lines_and_slots_are_read_whole():
    tree = TemplateTree()
    trace = "Traceback (most recent call last): " + "".join(f'File "/srv/label/part_{n}.py", line {n}, in build ' for n in range(30)) + "KeyError: 'x'"
    java = "java.lang.IllegalStateException: closed " + "".join(f"at label.export.Sheet{n}.write(Sheet{n}.java:{n}) " for n in range(30))
    page = "系统繁忙，请稍后再试。" * 60
    one = "Access denied: " + "record of the label, " * 30 + "you do not have permission"
    for t in (trace, java, page, one, "404 Not Found\n" + page):
        assert len(t.split("\n")[-1]) > 400 and is_residue(t, tree), t[:40]
    prose = "The label lists energy and protein per serving. " * 12
    for t in (prose, prose + "Access denied: you do not have permission.", "产品正文说明。" * 80 + "系统繁忙，请稍后再试。"):
        assert len(t) > 400 and not is_residue(t, tree), t[:40]
    long = "product.origin." * 8
    for t in ("{{ %s }}", "${%s}", "$[%s]", "[[%s]]", "<%%= %s %%>"):
        assert is_residue("产地：" + t % long, tree), t
    assert not is_residue("产地：{{ " + long + "\n }}", tree)
