"""Results must not depend on the session time zone (timestamps are
zone-free; week labels and report dates are computed without a zone)."""

from conftest import SF0001


def test_batch_queries_zone_independent(spark):
    import __spark_entry__ as E
    names = ["a1_weekly_cube", "f1_delivered", "h1_week_label", "h2_h4_calendar", "w10_row_split"]
    before = {n: sorted(E.queries()[n](spark, SF0001).collect()) for n in names}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        after = {n: sorted(E.queries()[n](spark, SF0001).collect()) for n in names}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for n in names:
        assert before[n] == after[n], n
