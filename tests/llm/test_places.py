import pytest

from labelloom.llm.places import Gazetteer, place_classes, same_places, spelling
from tests.conftest import rows


@pytest.fixture(scope="module")
def gazetteer(spark):
    return Gazetteer({"p": {"landong"}, "c": {"linyang", "cenling"}, "d": {"jinpu", "zixu"}}, {"jinpu": "linyang", "zixu": "cenling"}, spelling(spark))


def test_reading(gazetteer):
    G, s = gazetteer, gazetteer.spelling
    want = ("landong", "linyang", "jinpu", "lane", "qingzhou", "576", "7")
    for t in ["澜东省霖阳市金浦区青洲巷576号7号楼", "澜东霖阳市金浦清洲巷No.576号7幢", "青洲巷５７６#7#楼，金浦区，霖阳，澜东省（邮编101138）", "厂址:澜东·霖阳·金浦区·青洲巷五七六號·7座", "Building 7, No. 576 Qingzhou Lane, Jinpu Dist., Linyang City, Landong Prov., P.C. 101138", "LANDONG, LINYANG, JINPU, QING ZHOU LN #576, BLDG. 7"]:
        assert G.read(t) == want, t
    assert G.read("金浦区青洲巷576")[1] == "linyang"
    for t in [None, "", "不适用", "见包装", "待确认", "霖阳市", "n/a"]:
        assert G.read(t) is None
    assert s.spelled("鹿野") == s.spelled("陆墅") and s.is_sound("qingzhou") and not s.is_sound("qignzhou") and not s.is_sound("dongwaan")
    # names that occur in no test table
    for t in ["广州市体育东路138号", "138 Tiyu East Road, Guangzhou City", "No.138, East Tiyu Rd., Guangzhou City"]:
        assert G.read(t)[1] == "guangzhou" and G.read(t)[3:6] == ("road", "tiyudong", "138"), t
    assert G.read("中山大道中1218号")[3:6] == ("avenue", "zhongshanzhong", "1218") and G.read("锦绣花园三村5号")[3:6] == ("estate", "jinxiuhuayuansan", "5")
    assert G.read("重庆市渝中区解放碑街7号")[1] == "chongqing"
    assert G.read("((((((((((甲))))))))))金浦区青洲巷576")[3:6] == ("lane", "qingzhou", "576")


def test_pairs(spark):
    full = [f"澜东省霖阳市金浦区{s}路{n}号" for s, n in [("青洲", 1), ("白泉", 2), ("松桥", 3)] for _ in range(2)]
    texts = full + ["霖阳市金浦区青洲路1号", "No. 1, Qignzhou Road, Jinpu District, Linyang City, Landong Province", "No.2 Baiquan Rd, Jinpu Dist, Linyang City", "澜东省霖阳市金浦区青洲路1号2号楼", "澜东省霖阳市金浦区青洲街1号", None, " ", "不适用", "不适用", "路" * 3000]
    data = [(f"r{n:02d}", t, "x") for n, t in enumerate(texts)] + [("r00", full[0], "x"), (None, full[0], "x")]
    df = spark.createDataFrame(data, "rec string, addr string, city string")
    place = {"r00": 1, "r01": 1, "r06": 1, "r07": 1, "r02": 2, "r03": 2, "r08": 2, "r04": 3, "r05": 3}
    want = [(a, b) for a in sorted(place) for b in sorted(place) if a < b and place[a] == place[b]]
    assert rows(same_places(df, "rec", "addr")) == want
    links = {r: sum(r in p for p in want) for p in want for r in p}
    assert {r.rec: r.n_links for r in place_classes(df, "rec", "addr").collect()} == links
    assert same_places(df.where("false"), "rec", "addr").count() == 0
