from datewise.plans import catalogue


def test_activity_of_one_employee_is_its_part_of_all(spark):
    d = "/root/testdata/sf0.01"
    got = catalogue.queries()["employee_activity_all"](spark, d)
    part = catalogue.queries()["employee_activity"](spark, d)
    kinds = {r["kind"] for r in part.select("kind").distinct().collect()}
    assert kinds == {"version", "override", "assignment", "decision"}
    assert got.where("employee_id = 7").exceptAll(part).count() == 0 == part.exceptAll(got).count()
