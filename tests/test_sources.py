"""openFDA loaders on crafted pages: paging, limits, first-element picks, fallbacks."""

import json

from pyspark.sql import functions as F

from rxstar.sources import openfda as S
from rxstar.sources.landing import page_schema


def _event(i, drugs=None, reactions=None, serious="1"):
    return {"safetyreportid": str(i), "receivedate": "20250101", "serious": serious,
            "patient": {"patientsex": "1", "drug": drugs, "reaction": reactions}}


def _pages(spark, tmp_path, pages, kind="event"):
    path = tmp_path / kind
    path.mkdir()
    (path / "part-0.json").write_text("\n".join(json.dumps(p) for p in pages))
    return S.read_pages(spark, str(path), kind)


def test_paging_stops_after_first_short_page(spark, tmp_path):
    full = [{"skip": 0, "meta": {"results": {"total": 9}}, "results": [_event(i) for i in range(3)]},
            {"skip": 3, "meta": {"results": {"total": 9}}, "results": [_event(i) for i in range(3, 5)]},
            {"skip": 6, "meta": {"results": {"total": 8}}, "results": [_event(i) for i in range(6, 9)]}]
    pages = _pages(spark, tmp_path, full)
    got = [r["seq"] for r in S.paged_records(pages, limit=100, page_size=3).orderBy("seq").collect()]
    assert got == [0, 1, 2, 3, 4]  # the page after the short one is not read
    got = [r["seq"] for r in S.paged_records(pages, limit=4, page_size=3).collect()]
    assert sorted(got) == [0, 1, 2, 3]
    assert S.total_available(pages).collect()[0][0] == 8


def test_event_flatten_first_elements(spark, tmp_path):
    drugs = [{"medicinalproduct": "A", "openfda": {"brand_name": ["BA", "BB"], "manufacturer_name": []}},
             {"medicinalproduct": "B", "openfda": {"brand_name": ["X"], "manufacturer_name": ["M"]}}]
    page = {"skip": 0, "meta": {"results": {"total": 2}},
            "results": [_event(1, drugs, [{"reactionmeddrapt": "Death"}], serious="2"), _event(2, None, [], serious="")]}
    recs = S.records(_pages(spark, tmp_path, [page]))
    a, b = S.flatten_events(recs).orderBy("seq").collect()
    assert (a["medicinalproduct"], a["brand_name"], a["manufacturer_name"], a["reaction"], a["serious_code"], a["serious"]) == (
        "A", "BA", None, "Death", 2, 0)
    assert (b["medicinalproduct"], b["reaction"], b["serious"]) == (None, None, 0)
    a2, b2 = S.flatten_events_blank(recs).orderBy("seq").collect()
    assert (a2["manufacturer_name"], a2["serious"], b2["brand_name"]) == ("", 0, "")


def test_ndc_fallbacks_and_strict(spark, tmp_path):
    rec = {"product_ndc": "1", "product_type": None, "product_type_name": "T", "brand_name": "",
           "proprietary_name": "P", "generic_name": None, "nonproprietary_name": "N", "route": ["ORAL", "NASAL"],
           "marketing_start_date": "", "start_marketing_date": "2000", "labeler_name": "L" * 1200}
    pages = _pages(spark, tmp_path, [{"skip": 0, "meta": {"results": {"total": 1}}, "results": [rec]}], "ndc")
    r = S.flatten_ndc(S.records(pages)).collect()[0]
    assert (r["product_type_name"], r["proprietary_name"], r["nonproprietary_name"], r["route"],
            r["start_marketing_date"]) == ("T", "P", "N", "ORAL, NASAL", "2000")
    s = S.flatten_ndc_strict(S.records(pages)).collect()[0]
    assert (s["product_type_name"], s["proprietary_name"], len(s["labeler_name"])) == (None, "", 1000)


def test_date_range_and_load_limit(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["20231231", "20240101", "20261231", "20270101"])],
                               "seq long, receivedate string")
    assert [r[1] for r in S.event_date_range(df).collect()] == ["20240101", "20261231"]
    assert [r[0] for r in S.load_limit(df, limit=500, cap=2).collect()] == [0, 1]
    assert S.load_limit(df, limit=3, cap=S.EVENT_LOAD_CAP).count() == 3  # events: min(limit, 100)


def test_page_schema_is_explicit():
    assert page_schema("event")["results"].dataType.elementType["patient"] is not None
    assert F is not None


def test_csv_keeps_empty_text_apart_from_null(spark, tmp_path):
    from rxstar.schemas import IMPORT_RAW
    from rxstar.sources.raw import land_csv, scan_import_raw

    names = [f.name for f in IMPORT_RAW.fields]
    rows = [tuple(v for _ in names) for v in ("", None, "X", ' a "b", c ', "\\")]
    land_csv(spark.createDataFrame(rows, IMPORT_RAW), str(tmp_path / "raw"))
    back = [tuple(r) for r in scan_import_raw(spark, str(tmp_path / "raw")).collect()]
    assert sorted(back, key=repr) == sorted(rows, key=repr)
