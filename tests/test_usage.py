"""The README's usage flow on small hand-written exports."""

from tidemark.operators import attribution
from tidemark.plans import marts, mediums, paths
from tidemark.sources.files import read_csv

MC = """# Report
# Property
#
# 20220101-20221231
#

Country,Medium,Users,New Users,Sessions,Transactions,Revenue,Bounce Rate,Pages / Session,Avg. Session Duration,Ecommerce Conversion Rate
Spain,referral,5000,4000,9000,300,90000.5,0.4,3.1,120.0,0.033
Spain,(none),3000,2500,4000,100,20000,0.5,2.1,80.0,0.025
Croatia,cpc,2000,1900,2500,150,40000,0.3,2.5,60.0,0.06
Croatia,referral,1500,1200,2000,120,30000,0.35,2.8,90.0,0.06
"""

CP = """Medium Path,Conversions,Value
referral > (none),1,"EUR 1,234.50"
referral,2,EUR 100.00
cpc > referral > (none),1,EUR 0.00
"""


def test_readme_flow(spark, tmp_path):
    (tmp_path / "mc.csv").write_text(MC)
    (tmp_path / "cp.csv").write_text(CP)
    mc = read_csv(spark, str(tmp_path / "mc.csv"), comment="#", schema=(
        "Country string, Medium string, Users long, `New Users` long, Sessions long, "
        "Transactions long, Revenue double, `Bounce Rate` double, `Pages / Session` double, "
        "`Avg. Session Duration` double, `Ecommerce Conversion Rate` double"))
    by_country = marts.country_mart(mc)
    kept = by_country.filter(marts.keep_rule(20000, 1000, 100, "or"))
    cm = marts.country_medium_mart(mc, kept)
    cm = marts.drop_low_volume_mediums(marts.flag_low_volume_mediums(cm, 50, 5, 5))
    assert mediums.median_share_table(cm, kept).count() == 3
    assert mediums.bootstrap_revenue_per_transaction(cm, resamples=50).count() == 3
    raw = read_csv(spark, str(tmp_path / "cp.csv"),
                   schema="`Medium Path` string, Conversions double, Value string")
    clean = paths.clean_paths(raw)
    assert sorted(tuple(r) for r in clean.collect()) == [
        ("referral", 2, 100.0), ("referral > (none)", 1, 1234.5)]
    res = {r.channel_name: r for r in attribution.markov_model(clean).collect()}
    assert res["referral"].removal_effects_conversion == 1.0
    assert abs(sum(r.total_conversions for r in res.values()) - 3) < 1e-9
    assert abs(sum(r.total_conversion_value for r in res.values()) - 1334.5) < 1e-6
