"""Profiles of taxpayers."""

from foliospark.operators import profiles

FORM = "who string, document_id string, error string, extracted struct<employer:struct<value:string,bbox:int>,tds:array<struct<q:struct<value:int,bbox:int>>>>"
DEPOSIT = "who string, document_id string, error string, extracted struct<fd_entries:array<struct<bank:struct<value:string,bbox:int>,interest:string>>>"


def test_entries_of_each_kind(spark):
    forms = spark.createDataFrame([("a", "f1", None, (("E", 1), [((4, 2),), ((None, None),)])), ("a", "f2", "unreadable", (("F", 1), None)), (None, "f3", None, None)], FORM)
    deposits = spark.createDataFrame([("a", "d1", None, ([(("B", 1), "10"), None, (("C", None), "x")],)), ("b", "d2", None, ([],)), ("b", "d3", None, (None,)), ("b", "d4", None, None), ("b", "d5", "lost", None)], DEPOSIT)
    done = profiles.stitched("who", form16=forms, fd_interest=deposits)
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    got = {(r.document_id, r.position): (r.who, r.source, r.error, r.form16, r.fd_interest) for r in done.collect()}
    assert {k: v[:3] for k, v in got.items()} == {
        ("f1", 0): ("a", "form16", None), ("f2", None): ("a", "form16", "unreadable"), ("f3", 0): (None, "form16", None),
        ("d1", 0): ("a", "fd_interest", None), ("d1", 1): ("a", "fd_interest", None), ("d1", 2): ("a", "fd_interest", None), ("d5", None): ("b", "fd_interest", "lost"),
    }
    assert got["f1", 0][3].asDict(True) == {"employer": "E", "tds": [{"q": 4}, {"q": None}]} and got["f2", None][3] is None
    assert got["d1", 0][4].asDict() == {"bank": "B", "interest": "10"} and got["d1", 1][4] is None
    sums = profiles.totals(done, "who", {"interest": ("fd_interest", "interest")})
    assert sorted((str(r.who), *tuple(r)[1:]) for r in sums.collect()) == [("None", 1, 0, 0, 0.0), ("a", 1, 3, 1, 10.0), ("b", 0, 0, 1, 0.0)]
    assert profiles.stitched("who", form16=forms.limit(0), fd_interest=deposits.limit(0)).count() == 0
