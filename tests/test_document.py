import json

from tidemill.plans.model_reads import repo_document


def tables(spark):
    make = spark.createDataFrame
    return {
        "m01_repo_clusters": make([("o/a", 1), ("o/b", 2)], "repo_name string, cluster_id int"),
        "m02_repo_cluster_profile": make([(1, "steady"), (2, "core")], "cluster_id int, cluster_label string"),
        "m04_repo_dna": make([("o/a", 0.5), ("o/b", 0.25)], "repo_name string, watch_share double"),
        "q_cohort_averages": make([("hot", 0.4), ("cold", 0.1), ("mid", 0.2)], "cohort_group string, watch_share double"),
        "m14_repo_watcher_profile": make([("o/a", 7)], "repo_name string, watchers long"),
        "m13_repo_watcher_persona_lift": make([("o/b", "x", 1.5), ("o/b", "y", 2.5), ("o/a", "z", 9.0)], "repo_name string, persona_label string, lift double"),
        "g04_repo_community": make([("o/b", "o/a", 2)], "repo_name string, community_id string, community_size long"),
        "g03_repo_similarity_edges": make([("o/b", f"o/{i:02}", i / 20) for i in range(12)], "src_repo string, dst_repo string, jaccard double"),
        "m15_repo_association_rules": make([("o/a & o/b", "o/c", 2.0, 0.5), ("o/bb", "o/c", 4.0, 0.5), ("o/c", "o/b", 3.0, 0.5)], "antecedent string, consequent string, lift double, confidence double"),
        "b33_repo_top_actors_latest": make([("o/b", "u", 1), ("o/b", "v", 2)], "repo_name string, actor_login string, actor_rank long"),
    }


def test_document_has_all_ten_reads(spark):
    rows = repo_document(tables(spark)).collect()
    assert {r.repo_name for r in rows} == {"o/b"}
    got = {}
    for r in sorted(rows, key=lambda r: r.place):
        got.setdefault(r.section, []).append(json.loads(r.body))
    assert [p["cluster_label"] for p in got["cluster_profile"]] == ["core"] and got["cluster"] == [{"repo_name": "o/b", "cluster_id": 2}]
    assert got["dna"] == [{"repo_name": "o/b", "watch_share": 0.25}] and [c["cohort_group"] for c in got["cohort_averages"]] == ["cold", "hot", "mid"]
    assert [x["persona_label"] for x in got["watcher_lifts"]] == ["y", "x"] and "watcher_profile" not in got
    assert got["community"][0]["community_size"] == 2
    assert [e["dst_repo"] for e in got["similar"]] == [f"o/{i:02}" for i in range(11, 1, -1)]
    assert [x["antecedent"] for x in got["rules"]] == ["o/c", "o/a & o/b"], "a rule of a name that only begins alike is left out"
    assert [a["actor_login"] for a in got["top_actors"]] == ["u", "v"]


def test_document_of_a_named_an_unknown_and_no_repository(spark):
    held = tables(spark)
    named = {r.section for r in repo_document(held, "o/a").collect()}
    assert named == {"cluster", "cluster_profile", "dna", "cohort_averages", "watcher_profile", "watcher_lifts", "rules"}
    assert {r.section for r in repo_document(held, "o/none").collect()} == {"cohort_averages"}
    assert repo_document({k: v.limit(0) for k, v in held.items()}).isEmpty()
