"""Every core query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from webobs.plans import catalog

DATA = os.environ.get("WEBOBS_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = table(df.columns, df.collect())
    res = duck.execute(catalog.ORACLES[name])
    assert got == table([d[0] for d in res.description], res.fetchall())


# Queries without SQL, each with a test against a plain version of its definition (test_truth.py, test_anycast.py).
PLAIN = "anycast_sites vantage_report site_candidates assign_fixpoint harvest_dispatch hint_place html_document_text html_marked_text keyword_word_positions kwic_context structure_clusters tag_similarity".split()


def test_every_query_has_sql_or_a_plain_version():
    assert sorted(set(catalog.QUERIES) - set(catalog.ORACLES)) == sorted(PLAIN)


def test_every_query_of_the_blueprint_is_there():
    keys = """url_canonical url_first url_distinct url_scheme_fill url_filename url_host url_has_ip registrable_domain slugify url_asn md5_dedup keyword_score keyword_any triage_buckets
    keyword_positions kwic_context merge_spans tokens token_filter shingles jaccard_pairs best_match_edges components cluster_sizes two_stage_clusters html_text clean_lines tag_sequence tag_similarity
    list_links url_harvest anchored_links resolve_links link_demote diff_tfidf cluster_keywords keyword_share keyword_pairs purify_keywords search_terms org_tokens multimap cascade_lookup anti_seen
    semi_active inner_lookup cross_tasks contains_join interval_join vote_threshold noise_filter assign_first_round ip_valid ip_subnets bogon_filter cidr_lpm hop_min_rtt trace_success trace_fold
    purify_traces second_max_hop inverted_index site_groups anycast_sites haversine nearest_site distance_join forall_join residual_top3 top3_scopes rtt_gap location_vote coord_spread max_population
    continent_lookup distinct_locations group_concat last_per_key mode_first ip_else_hint hint_tokens precision_recall parse_features maxdiff_sample two_stage_label first_match_rule capability_filter
    probe_params priority_slices slice_ntile hash_sample frontier_round set_union set_except set_intersect bag_union source_union size_filter breadcrumb_url"""
    assert not set(keys.split()) - set(catalog.QUERIES)
