from tidemill.operators import ml
from tidemill.plans import catalog, registry
from tidemill.sources import storage

DATA = "/root/testdata/sf0.01"


def test_inputs_are_written_once_an_application(spark, monkeypatch):
    """Every frame wrote its inputs anew, also the whole of ev_graph."""
    paths = []
    monkeypatch.setattr(catalog, "kept_path", lambda s: paths.append(storage.kept_path(s)) or paths[-1])
    monkeypatch.setattr(registry.CATALOG, "kept", {})
    want = sorted(registry.CATALOG.frame(spark, DATA, "g02_scope_network").collect())
    registry.CATALOG.frame(spark, DATA, "g03_repo_similarity_edges")
    n = len(paths)
    assert n == 2  # the scope, and its actors
    registry.CATALOG.frame(spark, DATA, "g03_repo_similarity_edges")
    assert sorted(registry.CATALOG.frame(spark, DATA, "g02_scope_network").collect()) == want and len(paths) == n


def test_embedding_and_neighbours_share_their_counts(spark, monkeypatch):
    read, frame = [], registry._frame
    monkeypatch.setattr(registry, "_frame", lambda name, *where: read.append(name) or frame(name, *where))
    monkeypatch.setattr(registry, "_STORED", {})
    near = registry.queries()["m18_repo_als_neighbor"](spark, DATA)
    registry.queries()["m18_repo_embedding"](spark, DATA)
    assert near.count() and read.count("ev_graph") == 1


def test_rules_read_their_baskets_once(spark):
    """The baskets were computed anew for their number, the patterns and both sides of the frontier."""
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.createDataFrame([(f"a{i}", f"r{j}") for i in range(12) for j in range(2 + i % 2)], "actor_login string, repo_name string")
    assert ml.association_rules(rows.mapInPandas(each, rows.schema)).count()
    assert seen.value == rows.count()


def test_models_of_actors_share_their_features(spark, monkeypatch):
    """Every model computed the features of all actors anew, also for each pass of its fit."""
    read, frame = [], registry._frame
    monkeypatch.setattr(registry, "_frame", lambda name, *where: read.append(name) or frame(name, *where))
    monkeypatch.setattr(registry, "_STORED", {})
    found = registry.queries()
    for name in ("m09_actor_persona_bic", "m08_actor_persona", "q_actor_persona_centroids", "m16_bot_feature_importance"):
        assert found[name](spark, DATA).count(), name
    assert read.count("m07_actor_features") == 1
