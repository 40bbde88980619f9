import pytest

from labelloom.llm import scans
from tests.conftest import rows

BODY = ["Store the oat biscuits below 5 C, and keep the seal", "dry until opening. The cold-pressed statement moved", "配料表首位为白砂糖，其后依次是小麦粉与食用盐，顺序一致。", "产品标准代号与保质期两项存在混用的情况，共12条。"]


def _counted():
    import pyarrow as pa

    out = []
    for b in scans._count([pa.RecordBatch.from_arrays([pa.array(BODY * 40)], names=["t"])]):
        out += zip(*(c.to_pylist() for c in b.columns))
    return out


def _held(kind):
    return {k: n for what, k, _, n in _counted() if what == kind}


@pytest.fixture(scope="module")
def v():
    return scans.Vocabulary(_held("w"), _held("n"))


def test_misread(v):
    assert not any(v.misread(x) for x in BODY)
    for bad in ["Store the oat biscuits bel0w 5 C", "Sforc the oat", "staternent", "产晶标准代号", "白砂搪，其后", "共l2条。", "共1Z条。", "配科表首位"]:
        assert v.misread(bad), bad
    for good in ["Zanzibar Qx", "", "   ", "12条", "C", "新词汇"]:
        assert not v.misread(good), good
    assert v.repaired("Sforc the oat bel0w") == "Store the oat below"


def test_automaton_is_complete(v):
    """Every word within the bounds is retrieved: against the plain distance over shape edits."""
    words = [w for w in v.words if scans._latin(w)]
    shapes = [p.split(">") for p in scans.LATIN_SHAPES]
    for token in ["bel0w", "staternent", "0pening", "secd", "store", "cl", "statcmcnt", "rnovcd", "clry", "movecl"]:
        reach, layer = {token}, {token}
        for _ in range(3):
            layer = {t[:i] + there + t[i + len(read) :] for t in layer for there, read in shapes for i in range(len(t)) if t.startswith(read, i)}
            reach |= layer
        assert {w for w in words if w in reach and w != token} <= set(v.candidates(token)), token


def test_shape_edits_keep_the_word_key():
    for pair in scans.LATIN_SHAPES:
        there, read = pair.split(">")
        if (there + read).lower() == there + read and not (read.isdigit() and there.isdigit()):
            assert scans.word_key(there) == scans.word_key(read), pair


def test_frequent_misreads_are_doubted():
    """However many rare words there are: only a word that none can correct is not looked at."""
    rare = {f"rare{chr(97 + n // 26)}{chr(97 + n % 26)}": 2 for n in range(200)}
    v = scans.Vocabulary({**rare, "sleeve": 1000, "slceve": 150, "store": 160, "storc": 170}, {})
    assert v.misread("slceve") and not v.misread("sleeve") and not v.misread("storc")


def test_two_tiers_decide_as_one(v):
    """What the frequent part leaves open is answered by the whole counts as one vocabulary of them decides it."""
    texts = BODY + ["Store the oat biscuits bel0w 5 C", "Sforc the oat", "staternent", "产晶标准代号", "白砂搪，其后", "共l2条。", "共1Z条。", "配科表首位", "Zanzibar Qx", "新词汇", "xnow cIear 白目"]
    counts = _counted()
    for floor in (2, 30, 60, 100, 10_000):
        part = scans.Vocabulary(*({k: n for k, n in _held(kind).items() if n >= floor} for kind in "wn"), (floor, floor))
        for text in texts:
            s = scans.symbols(text)
            for x in zip(["\n", *s], s, [*s[1:], "\n"]):
                if not part.doubtful[x[1]]:
                    assert v.corrected[x] is None, (floor, x)
                    continue
                got = part.corrected[x]
                if got is scans.UNSURE:
                    q = scans.context(*x)
                    needed = set(scans.needed_counts(q))
                    got = scans.answered(q, [c for c in counts if (c[0], c[1]) in needed])
                assert (got is None) == (v.corrected[x] is None), (floor, x, got, v.corrected[x])


def _broken(line, following, counts):
    q = scans.broken_end(line, following)
    if q is None:
        return False
    needed = set(scans.needed_counts(q))
    return scans.answered(q, [c for c in counts if (c[0], c[1]) in needed]) is not None


def test_broken():
    counts = _counted()
    assert _broken("moved the state-", "ment under", counts) and _broken("keep the biscu-", None, counts) and _broken("the statem-", "", counts)
    assert not _broken("The cold-", "pressed statement", counts) and not _broken("The cold-", None, counts)
    assert not _broken("no hyphen", "x", counts) and not _broken("维生素D-", "异抗", counts)


def test_page_numbers():
    for t, n in [("— 3 —", 3), ("[2]", 2), ("页码：4", 4), ("第 5 页", 5), ("第1页 / 共3页", 1), ("P.2", 2), ("Page 2 of 3", 2), ("1 / 3", 1), ("7", 7), ("· l ·", 1), ("- 2 -", 2)]:
        assert scans.page_number_alone(t) == n, t
    for t in ["61%", "14/箱", "x 33", "538 g", "", "Page", "0070945536021", "第3版", "text"]:
        assert scans.page_number_alone(t) is None, t
    assert scans.split_header("内部编号 LB-1 受控文件  第2页") == ("内部编号 LB-1 受控文件", 2) and scans.split_header("Draft Rev.8") == ("Draft Rev.8", None)


def test_shape_key():
    for a, b in [("Printed for bottom", "Prinfcd for b0ffom"), ("batch modern", "bafcli rnoclern"), ("标签稿", "栎鉴稿"), ("Rev.8", "Rev.B")]:
        assert scans.shape_key(a) == scans.shape_key(b)
    assert scans.shape_key("left panel") != scans.shape_key("right panel")


A = "alignment_id string, ocr_line_id string, job_id string, page int, line_no int, pdf_text string, ocr_text string, pdf_span_ids array<string>, id string, edge string"
C = "candidate_id string, job_id string, text string, key string"


def _pages():
    out, k = [], 0
    for p in (1, 2, 3):
        lines = ["内部编号 LB-77 受控文件", *BODY[p:], *BODY[:p], "Our statem-" if p == 1 else "dry until 0pening.", "ent under the oat" if p == 1 else "保质期一致。", f"- {p} -"]
        for n, t in enumerate(lines, 1):
            k += 1
            out.append((f"a{k:02d}", f"o{k}", "j", p, n, BODY[(n - 1) % 4], t, None, "x", "y"))
    return out


def test_operator(spark):
    data = _pages()
    data += [data[0], ("n1", None, "j", None, None, None, None, None, None, None), ("n2", None, None, None, None, "", "", None, None, None), (None, None, "j", 1, 1, None, "x", None, None, None), ("big", None, "q", 1, 1, None, "白砂糖" * 5000, None, None, None)]
    filler = [(f"z{n}", None, f"k{n}", 1, m, b, b, None, None, None) for n in range(30) for m, b in enumerate(BODY)]
    al = spark.createDataFrame(data + filler, A)
    ca = spark.createDataFrame([("c1", "j", "内部编号 LB-77 受控文件\n" + BODY[0], "k"), ("c2", "j", BODY[2] + "\n- 2 -", "k"), ("c3", "j", None, None), ("c4", None, "a\nb", None), ("c5", "none", "moved the state-\nment under", "k"), (None, "j", "x", "k"), ("c1", "j", "内部编号 LB-77 受控文件\n" + BODY[0], "k")], C)
    got = rows(scans.noisy_records(al, ca))
    ids = {t[6]: [r[0] for r in data if r[0] and r[6] == t[6]] for t in data}
    want = {(i, "running_header") for i in set(ids["内部编号 LB-77 受控文件"])} | {(i, "page_number") for p in (1, 2, 3) for i in ids[f"- {p} -"]}
    want |= {(i, "misread") for i in ids["dry until 0pening."]} | {(i, "hyphen_break") for i in ids["Our statem-"]}
    want |= {("c1", "running_header"), ("c2", "page_number"), ("c5", "hyphen_break")}
    assert got == sorted(want)
    out = scans.paragraphs(al, ca).collect()
    page = "".join(r.text for r in out if (r.source, r.rec_id, r.page) == ("page", "j", 1))
    assert "LB-77" not in page and "- 1 -" not in page and "statement under" in page
    assert [r.text for r in out if r.rec_id == "c5"] == ["moved the statement under"] and {r.rec_id for r in out if r.source == "block"} == {"c1", "c2", "c4", "c5"}
    assert [len(r.text) for r in out if r.rec_id == "q"] == [15000] and [r.text for r in out if r.source == "line"] == []
    assert scans.noisy_records(al.where("false"), ca.where("false")).count() == 0 and scans.paragraphs(al.where("false"), ca.where("false")).count() == 0


def test_parts_of_a_page_share_no_broken_word(spark, monkeypatch):
    al = spark.createDataFrame(_pages() + [("l1", None, None, None, None, None, "loose line", None, None, None)], A)
    ca = spark.createDataFrame([], C)
    whole = scans.paragraphs(al, ca).collect()
    monkeypatch.setattr(scans, "PART_LINES", 1)
    cut = scans.paragraphs(al, ca).collect()
    text = lambda rows, page: "".join(r.text.replace(" ", "") for r in sorted(rows, key=lambda r: (r.part, r.par_no)) if r.page == page)
    assert all(text(whole, p) == text(cut, p) for p in (1, 2, 3)) and len(cut) > len(whole)
    assert [r.text for r in whole if r.source == "line"] == ["loose line"]


def _over_pages():
    """A job whose text runs over its pages, once within a word, with furniture between."""
    head = "内部编号 LB-77 受控文件"
    pages = [
        ["Store the oat biscuits below 5 C, and keep the seal"],
        ["dry until opening. The cold-pressed statement moved", "under the oat biscuits and keep the seal. Our statem-"],
        [],
        ["ent moved.", "产品标准代号与保质期两项存在混用的情况，共"],
        ["12条。", "Store the oat biscuits below 5 C, and keep the seal dry."],
        ["The cold-pressed statement moved", "710 g"],
        ["under the oat biscuits."],
    ]
    data = []
    for p, body in enumerate(pages, 1):
        for n, t in enumerate([head, *body, f"- {p} -"], 1):
            data.append((f"a{p}{n}", None, "j", p, n, None, t, None, None, None))
    return data + [(f"z{n}{m}", None, f"k{n}", 1, m, b, b, None, None, None) for n in range(30) for m, b in enumerate(BODY)]


def test_paragraphs_run_over_pages(spark, monkeypatch):
    al, ca = spark.createDataFrame(_over_pages(), A), spark.createDataFrame([], C)
    want = [
        (1, 1, "Store the oat biscuits below 5 C, and keep the seal dry until opening. The cold-pressed statement moved under the oat biscuits and keep the seal. Our statement moved."),
        (4, 2, "产品标准代号与保质期两项存在混用的情况，共12条。"),
        (5, 2, "Store the oat biscuits below 5 C, and keep the seal dry."),
        (6, 1, "The cold-pressed statement moved 710 g"),
        (7, 1, "under the oat biscuits."),
    ]
    pages = lambda: sorted((r.page, r.par_no, r.text) for r in scans.whole_paragraphs(al, ca).collect() if r.rec_id == "j")
    assert pages() == want
    monkeypatch.setattr(scans, "PART_LINES", 1)
    assert [x[2] for x in pages()] == [x[2] for x in want]


def test_blocks_lose_their_furniture(spark):
    al = spark.createDataFrame(_over_pages(), A)
    head = "内部编号 LB-77 受控文件"
    blocks = {
        "c1": f"{head}\n{BODY[0]}\n{BODY[1]}", "c2": f"- 1 -\n{head}  P2\n{BODY[2]}", "c3": f"{BODY[2]}\n· 5 ·", "c4": f"{BODY[2]}\n- 8 -",
        "c5": f"{BODY[0]}\n{BODY[1]}\n{head}\n{BODY[1]}\n{BODY[0]}", "c6": f"{head}\n- 2 -", "c7": head,
    }
    ca = spark.createDataFrame([(i, "j", t, None) for i, t in blocks.items()] + [("c1", None, blocks["c1"], None), ("d1", None, blocks["c1"], None)], C)
    got = {}
    for r in sorted(scans.whole_paragraphs(al, ca).where("source = 'block'").collect(), key=lambda r: r.par_no):
        got[r.rec_id] = got.get(r.rec_id, "") + r.text
    assert got["c1"] == f"{BODY[0]} {BODY[1]}" and got["c2"] == got["c3"] == BODY[2]
    # page 8 is none of the job's, a line in the midst of a block no header, one line no noise, another job's header a line
    assert got["c4"] == BODY[2] + "- 8 -" and head in got["c5"] and "c6" not in got and got["c7"] == head and got["d1"].startswith(head)
    noisy = {r.rec_id for r in scans.noisy_records(al, ca).where("noise_kind in ('running_header', 'page_number')").collect()}
    assert noisy & set(blocks) == {"c1", "c2", "c3", "c6"}
