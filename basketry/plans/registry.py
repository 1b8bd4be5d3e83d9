"""All retail queries by name, with the ANSI SQL that must give the same rows.

Each query's docstring names the operators of the blueprint's inventory that it runs.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import canonical_customer, half_even
from basketry.operators import clean, cluster, evaluate, fits, itemcf, models, monitor, popularity, rules, selection, serve, snapshot
from basketry.params import CUTOFFS, DEFAULT
from basketry.plans import oracles
from basketry.sources import invoice_lines, raw_lines, small, stored

QUERIES: dict = {}
# The columns of purchases that profiles, lists and truths are made of.
BOUGHT = ("invoice_no", "stock_code", "ts", "customer_id", "value")
ORACLE_SQL: dict = oracles.ORACLE_SQL


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


class Data:
    """The tables a query starts from, at one cut-off.

    What several parts of a plan read is written once to the shared folder when first
    asked for, so no branch makes it anew and a lost executor costs only its tasks. once:
    the query reads the purchases a single time, so nothing of them is written. Without texts
    the purchases have only the columns that profiles, lists and truths are made of.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, role: str = "test", once: bool = False, texts: bool = True):
        self.spark, self.role, self.cutoff, self.sf_dir = spark, role, CUTOFFS[role], sf_dir
        bought = clean.purchases(self.lines) if texts else clean.purchases(clean.classified(raw_lines(spark, sf_dir, keyed=True, sound=True))).select(*BOUGHT)
        self.bought = bought if once else stored(bought, "bought")

    @classmethod
    def of(cls, bought: DataFrame, role: str) -> Data:
        """The same over purchases that are a table already."""
        self = object.__new__(cls)
        self.spark, self.role, self.cutoff, self.bought = bought.sparkSession, role, CUTOFFS[role], bought
        return self

    def at(self, role: str) -> Data:
        return Data.of(self.bought, role)

    def among(self, asked: DataFrame) -> Data:
        """The same with lists for the asked customers (customer_id) only; what is popular and alike all customers say."""
        d, only = Data.of(self.bought, self.role), lambda df: df.join(small(asked), "customer_id", "left_semi")
        d.items, d.world, d.segment, d.codes, d.near = self.items, self.world, self.segment, self.codes, self.near
        d.known, d.assigned, d.baskets = only(self.known), only(self.assigned), stored(only(self.baskets), "asked")
        return d

    raw = property(lambda self: raw_lines(self.spark, self.sf_dir))
    lines = property(lambda self: clean.classified(raw_lines(self.spark, self.sf_dir, keyed=True)))
    past = property(lambda self: (self.bought, self.cutoff))
    profiles = property(lambda self: snapshot.rfm_profiles(*self.past))
    known = cached_property(lambda self: stored(self.profiles, "profiles"))
    lasts = cached_property(lambda self: stored(snapshot.last_purchases(self.bought, self.cutoff), "lasts"))
    items = cached_property(lambda self: stored(snapshot.catalog_of(self.lasts, self.cutoff), "items"))
    owned = property(lambda self: self.lasts.select("customer_id", "stock_code"))
    # Distinct interactions over the catalog: what `snapshot.interactions` gives.
    pairs = cached_property(lambda self: self.owned.join(small(self.items.select("stock_code")), "stock_code", "left_semi").select("customer_id", "stock_code"))
    names = property(lambda self: snapshot.descriptions(self.bought, self.cutoff))
    assigned = cached_property(lambda self: stored(rules.rule_segments(rules.scores(self.known)), "assigned"))
    world = cached_property(lambda self: stored(popularity.global_scores(self.lasts, self.items, self.cutoff), "world"))
    segment = cached_property(lambda self: stored(popularity.segment_scores(self.lasts, self.items, self.assigned, self.cutoff), "segment"))
    n_items = property(lambda self: self.items.agg(F.count("*").alias("n_items")))
    known_count = property(lambda self: self.known.agg(F.count("*").alias("n")))
    points = property(lambda self: cluster.measures(self.known))
    codes = cached_property(lambda self: stored(itemcf.numbered(self.pairs), "numbered"))
    baskets = cached_property(lambda self: stored(itemcf.baskets(self.pairs, self.codes), "baskets"))
    near = cached_property(lambda self: stored(self.neighbours(most=max(DEFAULT.neighbour_choices)), "near"))
    found = cached_property(lambda self: {})

    def neighbours(self, tfidf: bool = False, most: int = DEFAULT.neighbours) -> DataFrame:
        idf = itemcf.item_idf(self.pairs, self.known_count) if tfidf else None
        return itemcf.near_items(self.baskets, self.codes, idf, most=most)

    def candidates(self, n: int = DEFAULT.neighbours, k: int | None = None, new_only: bool = False, backers: int = 0) -> DataFrame:
        """The scores by n neighbours: all of them, or what may be among a customer's k best."""
        return itemcf.best_candidates(self.baskets, self.codes, self.near, (n,), k, new_only, backers)

    def best(self, n: int, k: int, new_only: bool = False, backers: int = 0, choices: tuple[int, ...] = ()) -> DataFrame:
        """A customer's candidates for k places by n neighbours, with `backers` supporters each, stored once.

        choices: all numbers of neighbours that the query is going to ask for, which one pass scores together.
        """
        for (bounds, *rest), held in self.found.items():
            if n in bounds and rest == [k, new_only, backers]:
                return held.where(F.col("bound") == n)
        bounds = tuple(sorted({n, *choices}))
        held = stored(itemcf.best_candidates(self.baskets, self.codes, self.near, bounds, k, new_only, backers), "best")
        self.found[bounds, k, new_only, backers] = held
        return held.where(F.col("bound") == n)

    def lists(self, new_only: bool = False, k: int = DEFAULT.k, n: int = DEFAULT.neighbours, backers: int = 0, choices: tuple[int, ...] = ()) -> DataFrame:
        scored = self.best(n, k, new_only, backers, choices)
        return serve.fallback_lists(scored, self.assigned.select("customer_id", "segment_id"), self.segment, self.world, self.owned if new_only else None, k, new_only)

    def explained(self, new_only: bool = False, k: int = DEFAULT.k, n: int = DEFAULT.neighbours) -> DataFrame:
        """The lists by n neighbours (0: the segment's popularity) with their reasons."""
        if n:
            lists, backers = self.lists(new_only, k, n, DEFAULT.supporters), self.best(n, k, new_only, DEFAULT.supporters).select("customer_id", "stock_code", "supporters")
        else:
            lists, backers = self.segment_lists(k, new_only), self.spark.createDataFrame([], "customer_id string, stock_code string, supporters array<string>")
        return serve.explained(lists, backers, self.names, self.assigned)

    def popular_lists(self, k: int = DEFAULT.k) -> DataFrame:
        return serve.global_lists(self.known.select("customer_id"), self.world, k)

    def segment_lists(self, k: int = DEFAULT.k, new_only: bool = False) -> DataFrame:
        nothing = self.spark.createDataFrame([], "customer_id string, stock_code string, score double")
        return serve.fallback_lists(nothing, self.assigned.select("customer_id", "segment_id"), self.segment, self.world, self.owned if new_only else None, k, new_only)

    def lists_of(self, model: str, new_only: bool = False, k: int = DEFAULT.k) -> DataFrame:
        """The lists of a model by its name; without item-to-item filtering a release serves the segment's popularity."""
        if model in CF_MODELS:
            return self.lists(new_only, k, int(model.rpartition("_N")[2]))
        return self.segment_lists(k, new_only)

    def truth(self, cohort: str) -> DataFrame:
        return evaluate.truth(self.bought, self.items, self.cutoff, cohort)

    @cached_property
    def judged(self) -> tuple[Data, DataFrame]:
        """(the same for those customers that have a truth, the truth): nobody else's lists are looked at."""
        truth = stored(self.truth("primary"), "truth")
        return self.among(stored(truth.select("customer_id").distinct(), "judged")), truth

    @cached_property
    def metrics(self) -> dict[str, DataFrame]:
        """Each model's metrics by customer, baselines first."""
        d, truth = self.judged
        lists = {"GlobalPopularity": d.popular_lists(), "SegmentPopularity": d.segment_lists()} | {f"ItemItemCF_N{n}": d.lists(n=n, choices=DEFAULT.neighbour_choices) for n in DEFAULT.neighbour_choices}
        return {name: stored(evaluate.user_metrics(x, truth), "metrics") for name, x in lists.items()}


def lean(spark: SparkSession, sf_dir: str, role: str = "test", once: bool = False) -> Data:
    """The tables of a query that reads no texts of purchases."""
    return Data(spark, sf_dir, role, once, texts=False)


BASELINES = ("GlobalPopularity", "SegmentPopularity")
CF_MODELS = tuple(f"ItemItemCF_N{n}" for n in DEFAULT.neighbour_choices)


@query
def raw_lines_profile(spark, sf_dir):
    """A4, A6, A12."""
    return clean.provenance(invoice_lines(spark, sf_dir))


@query
def clean_audit(spark, sf_dir):
    """C1-C10."""
    return clean.audit(lean(spark, sf_dir, once=True).lines)


@query
def clean_purchases(spark, sf_dir):
    """C1-C8, C11, S1-S8."""
    return Data(spark, sf_dir, once=True).bought.select("invoice_no", "stock_code", "description", "quantity", "ts", "customer_id", "country", "value")


@query
def customer_id_canonical(spark, sf_dir):
    """S3, S5."""
    raw = invoice_lines(spark, sf_dir).select("CustomerID", canonical_customer(F.col("CustomerID")).alias("customer_id"))
    return raw.groupBy("customer_id").agg(F.count("*").alias("n_rows"))


@query
def excluded_codes(spark, sf_dir):
    """C9."""
    return clean.excluded_codes(lean(spark, sf_dir, once=True).lines)


@query
def anonymous_value(spark, sf_dir):
    """C4."""
    return clean.anonymous_value(lean(spark, sf_dir, once=True).lines)


@query
def purchases_provenance(spark, sf_dir):
    """A12 over kept lines, A11 on the span of time."""
    bought = lean(spark, sf_dir, once=True).bought
    out = bought.agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.withColumn("digest", F.upper(F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.date_format("first_ts", "yyyy-MM-dd"), F.date_format("last_ts", "yyyy-MM-dd")), 256)))


@query
def spend_concentration(spark, sf_dir):
    """G16."""
    return clean.concentration(lean(spark, sf_dir).bought)


@query
def rfm_profiles(spark, sf_dir):
    """F1, S9, S10, G1-G3."""
    return lean(spark, sf_dir, once=True).profiles


@query
def rfm_profiles_early(spark, sf_dir):
    """F1 at the early cut-off."""
    return lean(spark, sf_dir, "early", once=True).profiles


@query
def known_inactive(spark, sf_dir):
    """J2."""
    return lean(spark, sf_dir, once=True).profiles.where(F.col("status") == snapshot.INACTIVE).select("customer_id", "recency_days")


@query
def rfm_metadata(spark, sf_dir):
    """F2, G13."""
    return snapshot.rfm_metadata(lean(spark, sf_dir, once=True).profiles)


@query
def rfm_reconciliation(spark, sf_dir):
    """Spend by customer against spend by purchase."""
    d = lean(spark, sf_dir)
    return snapshot.reconciliation(d.profiles, d.bought, d.cutoff)


@query
def catalog_items(spark, sf_dir):
    """F3, J12."""
    d = lean(spark, sf_dir, once=True)
    return snapshot.catalog(d.bought, d.cutoff)


@query
def catalog_descriptions(spark, sf_dir):
    """W1, J4."""
    return Data(spark, sf_dir, once=True).names


@query
def interactions(spark, sf_dir):
    """F4, J1."""
    return lean(spark, sf_dir).pairs


@query
def customer_histories(spark, sf_dir):
    """G4."""
    return snapshot.history(*lean(spark, sf_dir, once=True).past).select("customer_id", "stock_code").groupBy("customer_id").agg(F.array_join(F.array_sort(F.collect_set("stock_code")), ",").alias("codes"))


@query
def rfm_cutpoints(spark, sf_dir):
    """G6, M5."""
    return rules.cutpoints(lean(spark, sf_dir, once=True).profiles)


@query
def rfm_scores(spark, sf_dir):
    """S13."""
    return rules.scores(lean(spark, sf_dir, once=True).known).select("customer_id", "r_score", "f_score", "m_score")


@query
def rfm_rule_segments(spark, sf_dir):
    """S14, M5, F5."""
    return lean(spark, sf_dir).assigned.select("customer_id", "segment_id", "segment_label")


@query
def segment_profiles(spark, sf_dir):
    """M14, G7, G8."""
    return rules.segment_profiles(lean(spark, sf_dir).assigned)


@query
def segment_labels(spark, sf_dir):
    """S15."""
    return rules.cluster_names(rules.segment_profiles(lean(spark, sf_dir).assigned)).select("segment_id", "label", "hypothesis")


@query
def segment_ordinals(spark, sf_dir):
    """W7, S21."""
    return rules.ordinals(rules.segment_profiles(lean(spark, sf_dir).assigned)).select("segment_id", "ordinal")


@query
def global_popularity(spark, sf_dir):
    """R1, R2, W2."""
    return popularity.top_ranked(lean(spark, sf_dir).world, 100)


@query
def segment_popularity(spark, sf_dir):
    """R3, W3, J3."""
    return popularity.top_ranked(lean(spark, sf_dir).segment, 20, ("segment_id",))


def _pair_counts(d: Data) -> DataFrame:
    return itemcf.pair_counts(d.baskets, d.codes, 2)


@query
def item_pair_cobuyers(spark, sf_dir):
    """J5."""
    return _pair_counts(lean(spark, sf_dir))


@query
def item_cosine_neighbors(spark, sf_dir):
    """R5, W4."""
    near = lean(spark, sf_dir).neighbours()
    return near.select("seed", "neighbour", half_even(F.col("sim"), 10).alias("sim"), "rank")


@query
def item_idf(spark, sf_dir):
    """R6."""
    d = lean(spark, sf_dir)
    return itemcf.item_idf(d.pairs, d.known_count).select("stock_code", "n_buyers", half_even(F.col("idf"), 8).alias("idf"))


@query
def item_tfidf_neighbors(spark, sf_dir):
    """R6."""
    near = lean(spark, sf_dir, "early").neighbours(tfidf=True)
    return near.select("seed", "neighbour", half_even(F.col("sim"), 10).alias("sim"), "rank")


@query
def cf_candidate_scores(spark, sf_dir):
    """R7, J6."""
    return lean(spark, sf_dir, "early").candidates().select("customer_id", "stock_code", half_even(F.col("score"), 8).alias("score"))


@query
def cf_supporters(spark, sf_dir):
    """R8, W6, S17, S19."""
    d = lean(spark, sf_dir, "early")
    return d.candidates(backers=DEFAULT.supporters).select("customer_id", "stock_code", F.array_join("supporters", ", ").alias("supporters"))


@query
def cf_topk_repeat(spark, sf_dir):
    """W5."""
    return itemcf.top_candidates(lean(spark, sf_dir).candidates(k=DEFAULT.k), DEFAULT.k).select("customer_id", "rank", "stock_code", half_even(F.col("score"), 8).alias("score"))


@query
def cf_topk_new_items(spark, sf_dir):
    """W5, J7."""
    d = lean(spark, sf_dir)
    return itemcf.top_candidates(d.candidates(k=DEFAULT.k, new_only=True), DEFAULT.k).select("customer_id", "rank", "stock_code", half_even(F.col("score"), 8).alias("score"))


def _rounded(lists: DataFrame) -> DataFrame:
    return lists.select("customer_id", "rank", "stock_code", half_even(F.col("score"), 8).alias("score"), "method")


@query
def recs_with_fallback(spark, sf_dir):
    """R9, R10, J13, J14, W10."""
    return _rounded(lean(spark, sf_dir, "test").lists())


@query
def recs_with_fallback_early(spark, sf_dir):
    """R9 where most lists fall back."""
    return _rounded(lean(spark, sf_dir, "early").lists())


@query
def recs_new_items_with_fallback(spark, sf_dir):
    """R9, J7."""
    return _rounded(lean(spark, sf_dir, "early").lists(new_only=True))


@query
def recs_segment_popularity(spark, sf_dir):
    """R4."""
    return _rounded(lean(spark, sf_dir, "early").segment_lists())


@query
def recs_unknown_customers(spark, sf_dir):
    """R2, V4: customers that only the future knows."""
    d = lean(spark, sf_dir, "early")
    return serve.global_lists(d.truth("cold_start").select("customer_id").distinct(), d.world, DEFAULT.k)


@query
def response_status(spark, sf_dir):
    """V5."""
    d = lean(spark, sf_dir, "early")
    return serve.response_status(d.lists(), d.known, d.n_items, DEFAULT.k)


@query
def recs_csv_safe(spark, sf_dir):
    """A7, R8, S17-S19."""
    return serve.csv_rows(Data(spark, sf_dir, "early").explained())


@query
def customer_profile_lookup(spark, sf_dir):
    """Every known customer with segment."""
    return lean(spark, sf_dir).assigned.select("customer_id", "recency_days", "frequency_invoices", "monetary_gbp", "status", "segment_id", "segment_label")


def _truth(spark, sf_dir, cohort, role):
    return lean(spark, sf_dir, role).truth(cohort)


@query
def cohort_counts(spark, sf_dir):
    """E1, J8, J9, G5."""
    d = lean(spark, sf_dir, "early")
    return evaluate.cohort_counts(d.bought, d.items, d.cutoff)


@query
def cohort_primary_truth(spark, sf_dir):
    """E1."""
    return _truth(spark, sf_dir, "primary", "test")


@query
def cohort_cold_start_truth(spark, sf_dir):
    """E1."""
    return _truth(spark, sf_dir, "cold_start", "early")


@query
def cohort_new_product_truth(spark, sf_dir):
    """E1."""
    return _truth(spark, sf_dir, "new_product", "test")


@query
def future_item_coverage(spark, sf_dir):
    """E1, G5."""
    d = lean(spark, sf_dir)
    return evaluate.future_coverage(d.bought, d.items, d.cutoff)


@query
def user_ranking_metrics(spark, sf_dir):
    """E2, S16, W11."""
    d, truth = lean(spark, sf_dir).judged
    return evaluate.user_metrics(d.lists(), truth)


def compared(d: Data) -> DataFrame:
    """A row for each model: both baselines and item-to-item filtering with each number of neighbours."""
    parts = [evaluate.summary(x, name) for name, x in d.metrics.items()]
    return stored(reduce(DataFrame.unionAll, parts), "compared")


@query
def model_comparison(spark, sf_dir):
    """E3, G10."""
    return compared(lean(spark, sf_dir))


@query
def strongest_baseline(spark, sf_dir):
    """The popularity model to beat; the segment's only where it is better."""
    return evaluate.strongest(compared(lean(spark, sf_dir)), BASELINES)


@query
def best_neighbour_count(spark, sf_dir):
    """The number of neighbours to put forward; of equals the smaller one."""
    return evaluate.strongest(compared(lean(spark, sf_dir)), CF_MODELS)


@query
def coverage_and_fallback(spark, sf_dir):
    """G11, G12."""
    d = lean(spark, sf_dir, "early")
    return evaluate.list_shares(stored(d.lists(), "lists"), d.n_items)


@query
def bootstrap_ci_hash(spark, sf_dir):
    """E4."""
    d = lean(spark, sf_dir)
    return evaluate.bootstrap(d.metrics[CF_MODELS[0]], d.metrics["SegmentPopularity"])


def gate(d: Data) -> DataFrame:
    """E5 over the strongest baseline and the best number of neighbours, one row; the two are chosen from a few rows."""
    means = compared(d)
    baseline, candidate = (evaluate.strongest(means, names).first() for names in (BASELINES, CF_MODELS))
    of = lambda x: means.where(F.col("model") == x.model)
    judged = evaluate.promotion(of(baseline), of(candidate), evaluate.bootstrap(d.metrics[candidate.model], d.metrics[baseline.model]))
    chosen = F.when(F.col("qualifies"), candidate.model).otherwise(baseline.model)
    return judged.select(F.lit(baseline.model).alias("baseline"), F.lit(candidate.model).alias("candidate"), *judged.columns, chosen.alias("selected"))


@query
def promotion_gate(spark, sf_dir):
    """Item-to-item filtering with 50 or 100 neighbours, whichever is better, against the stronger popularity model."""
    return gate(lean(spark, sf_dir))


def _six(points: DataFrame) -> DataFrame:
    return points.select("customer_id", *(half_even(F.col(c), 6).alias(c) for c in "rfm"))


@query
def source_digest(spark, sf_dir):
    """The raw lines' digest, whatever their order."""
    return selection.table_digest(raw_lines(spark, sf_dir), 6)


@query
def selection_manifest(spark, sf_dir):
    """V1, V8: what the validation cut-off selects, with the digests that a refit checks."""
    d = lean(spark, sf_dir, "validation")
    return selection.manifest(d.raw, gate(d), d.cutoff)


@query
def rfm_log1p_standardized(spark, sf_dir):
    """M1, S11, S12."""
    return _six(cluster.standardized(cluster.log1p(lean(spark, sf_dir).points)))


# Lambdas and centres of the queries that SQL repeats.
LAMBDAS = {"r": 0.5, "f": 0.0, "m": 0.25}
CENTRES = ((0, -1.0, -1.0, -1.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0))


@query
def yeo_johnson_fixed_lambda(spark, sf_dir):
    """M2 with given lambdas."""
    return _six(cluster.powered(lean(spark, sf_dir).points, LAMBDAS))


@query
def yeo_johnson_lambda_grid(spark, sf_dir):
    """M2: likelihood over a grid."""
    grid = spark.createDataFrame([(c, i / 4) for c in "rfm" for i in range(-4, 9)], "measure string, lambda double")
    found = cluster.power_likelihood(lean(spark, sf_dir).points, grid)
    return found.select("measure", "lambda", half_even(F.col("loglik"), 3).alias("loglik"))


@query
def quantile_normal_rfm(spark, sf_dir):
    """M3."""
    return cluster.quantile_normal(lean(spark, sf_dir).points)


@query
def kmeans_lloyd_step(spark, sf_dir):
    """M6: one step from given centres."""
    centres = spark.createDataFrame(CENTRES, "cluster int, r double, f double, m double")
    return cluster.lloyd_step(cluster.standardized(cluster.log1p(lean(spark, sf_dir).points)), centres)


@query
def kmeans_segments(spark, sf_dir):
    """M6, M2, F5."""
    return cluster.kmeans(cluster.transformed(lean(spark, sf_dir).points), 3)


@query
def gmm_segments(spark, sf_dir):
    """M7, full covariance."""
    return cluster.gaussian_mixture(cluster.transformed(lean(spark, sf_dir).points), 3)


@query
def gmm_diagonal_segments(spark, sf_dir):
    """M7, diagonal covariance."""
    return cluster.gaussian_mixture(cluster.transformed(lean(spark, sf_dir).points), 3, "diag")


def _rule_labelled(d: Data) -> DataFrame:
    return stored(cluster.rule_labelled(d.assigned), "labelled")


@query
def silhouette_rules(spark, sf_dir):
    """M8."""
    return cluster.silhouette(_rule_labelled(lean(spark, sf_dir)))


@query
def davies_bouldin_rules(spark, sf_dir):
    """M9."""
    return cluster.davies_bouldin(_rule_labelled(lean(spark, sf_dir)))


@query
def rule_baseline(spark, sf_dir):
    """The rules judged like a model of the grid."""
    return cluster.rule_baseline(lean(spark, sf_dir).assigned).select("family", "k", half_even(F.col("min_share"), 4).alias("min_share"), "silhouette", "davies_bouldin")


@query
def adjusted_rand(spark, sf_dir):
    """Rule segments at the validation and test cut-offs."""
    d = lean(spark, sf_dir)
    label = lambda x: x.assigned.where(F.col("status") == snapshot.ACTIVE).select("customer_id", F.col("segment_id").alias("cluster"))
    return cluster.adjusted_rand(label(d.at("validation")), label(d))


@query
def cluster_candidates(spark, sf_dir):
    """Every model of the grid with what the gates read, and the rules beside them."""
    d = lean(spark, sf_dir)
    found = fits.candidates(cluster.transformed(d.points)).unionByName(cluster.rule_baseline(d.assigned))
    return found.select("family", "covariance", "k", *(half_even(F.col(c), 4).alias(c) for c in ("min_share", "ari", "silhouette", "davies_bouldin")), "bic")


@query
def cluster_selection(spark, sf_dir):
    """K-Means and mixtures of both covariances over k, five seeds and all restarts, gated and ranked."""
    return cluster.selection(fits.candidates(cluster.transformed(lean(spark, sf_dir).points)))


def chosen_model(d: Data) -> models.Model:
    """The model that `cluster_selection` chooses, fitted, written as a table and read back."""
    choice = cluster.selection(fits.candidates(cluster.transformed(d.points))).first()
    return models.read(stored(models.fit(d.known, *choice), "model"))


@query
def learned_model(spark, sf_dir):
    """The chosen model as a table."""
    model = chosen_model(lean(spark, sf_dir))
    return spark.createDataFrame(model.rows, models.SCHEMA)


@query
def learned_segments(spark, sf_dir):
    """Profile, order and name of each segment of the chosen model."""
    d = lean(spark, sf_dir)
    return models.summary(models.assign(d.known, chosen_model(d)), d.cutoff, d.role)


@query
def learned_assignment(spark, sf_dir):
    """the chosen model's segments; inactive customers are a segment apart."""
    d = lean(spark, sf_dir)
    return models.assign(d.known, chosen_model(d)).select("customer_id", "segment_id", "segment_label")


@query
def rule_model_segments(spark, sf_dir):
    """The rules of the validation cut-off as a stored model that labels the customers of the test cut-off."""
    d = lean(spark, sf_dir)
    model = models.read(stored(models.fit(d.at("validation").known, *models.RULES), "model"))
    return models.summary(models.assign(d.known, model), d.cutoff, d.role)


@query
def snapshot_summary(spark, sf_dir):
    """D1."""
    return monitor.snapshot_summary(lean(spark, sf_dir, once=True).known)


@query
def drift_rfm(spark, sf_dir):
    """D2."""
    d = lean(spark, sf_dir)
    return monitor.median_drift(monitor.snapshot_summary(d.at("early").known), monitor.snapshot_summary(d.known))


@query
def drift_segments(spark, sf_dir):
    """D3, J11."""
    d = lean(spark, sf_dir)
    return monitor.share_drift(monitor.segment_shares(d.at("early").assigned), monitor.segment_shares(d.assigned))


@query
def drift_catalog(spark, sf_dir):
    """D4, J10, G14."""
    d = lean(spark, sf_dir)
    return monitor.catalog_drift(d.at("early").items, d.items)


def _fallback_drift(d: Data) -> DataFrame:
    return monitor.fallback_drift(monitor.fallback_share(d.at("early").lists()), monitor.fallback_share(d.lists()))


@query
def drift_fallback(spark, sf_dir):
    """From the early to the test cut-off."""
    return _fallback_drift(lean(spark, sf_dir))


@query
def snapshot_overview(spark, sf_dir):
    """D1."""
    d = lean(spark, sf_dir, "early")
    return monitor.overview(d.known, d.items, monitor.fallback_share(d.lists()))


@query
def segment_shares(spark, sf_dir):
    """D1, G8."""
    return monitor.segment_shares(lean(spark, sf_dir).assigned)


def snapshot_rows(d: Data) -> DataFrame:
    """D1 as the rows of a snapshot table."""
    return monitor.snapshot_rows(d.cutoff, d.known, d.assigned, d.items, monitor.fallback_share(d.lists()))


@query
def stored_snapshot(spark, sf_dir):
    """All that a later comparison reads of a snapshot."""
    return snapshot_rows(lean(spark, sf_dir))


@query
def drift_alerts(spark, sf_dir):
    """Two stored snapshots compared, the early one and that of the test cut-off."""
    d = lean(spark, sf_dir)
    early = d.at("early")
    table = stored(snapshot_rows(early).unionAll(snapshot_rows(d)), "snapshots")
    return monitor.report(monitor.compared(table, early.cutoff, d.cutoff))
