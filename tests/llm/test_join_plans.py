import pytest

from skerry.llm import common, components, simhash


def auto_broadcasts(df) -> int:
    """Joins whose broadcast nobody asked for."""
    made = df._jdf.queryExecution()
    plan = made.executedPlan().toString()
    return plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin") - made.optimizedPlan().toString().count("strategy=broadcast")


def test_no_table_of_simhash_groups_is_broadcast_by_its_guessed_size(spark, monkeypatch):
    plans, real = {}, common.stored

    def seen(df, name):
        plans.setdefault(name, []).append(auto_broadcasts(df))
        return real(df, name)

    for module in (common, components, simhash):
        monkeypatch.setattr(module, "stored", seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    rows = [(k, " ".join(f"w{k % 40}x{i % (3 + k % 40)}" for i in range(60))) for k in range(400)]
    groups = simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    plans["result"] = [auto_broadcasts(groups)]
    assert {"cells", "pairs", "links", "components", "groups"} <= set(plans)
    assert {name for name, found in plans.items() if any(found)} == set()
    got = groups.collect()
    assert len(got) == 400 and all(r["component_id"] <= r["doc_id"] % 40 for r in got)


@pytest.mark.parametrize("joined", ["left", "right"])
def test_by_shuffle_keeps_a_join_from_broadcasts_on_either_side(spark, joined):
    wide, few = spark.range(5000).selectExpr("id", "explode(sequence(0, 64)) AS k"), spark.range(3)
    made = few.join(common.by_shuffle(wide), "id") if joined == "right" else common.by_shuffle(few).join(wide, "id")
    assert auto_broadcasts(made) == 0 and made.count() == 195
