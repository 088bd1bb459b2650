"""Feature selection and dimension reduction."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.catalog.shared import document_features, embedding_columns, embedding_sql
from gaugewell.functions.columns import tidy
from gaugewell.operators import reduce as red
from gaugewell.operators import select

E8 = [f"e{i}" for i in range(8)]
E64 = [f"e{i}" for i in range(64)]
DOC = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share"]


def _rounded(df, digits=6):
    return df.select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("variance_threshold", " union all ".join(f"select '{c}' as feature, {r(f'var_pop({c})')} as score, var_pop({c}) > 0.001 as selected from lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def variance_threshold(load):
    return _rounded(select.variance_threshold(load("lineitem"), ["l_quantity", "l_discount", "l_tax"], 0.001))


def _anova(c):
    return f"select '{c}' as feature, (b/(k-1))/(w/(n-k)) as score from (select sum(n) n, count(*)::double k, sum(n*m*m)-pow(sum(n*m),2)/sum(n) b, sum((n-1)*v) w from (select count(*)::double n, avg({c}) m, var_samp({c}) v from t group by label))"


@query(
    "univariate_classification",
    f"with t as ({embedding_sql(8, True)}), s as ({' union all '.join(_anova(c) for c in E8)}), k as (select *, row_number() over (order by score desc, feature) rk from s) select feature, {r('score',4)} as score, rk::integer as \"rank\", rk <= 3 as selected from k",
)
def univariate_classification(load):
    return _rounded(select.univariate_f(embedding_columns(load, 8, True), "label", E8, k=3).drop("p_value"), 4)


@query(
    "univariate_regression",
    "with s as (" + " union all ".join(f"select '{c}' as feature, pow(corr({c}, l_extendedprice),2)/(1-pow(corr({c}, l_extendedprice),2))*(count(*)-2) as score from lineitem" for c in ("l_quantity", "l_discount", "l_tax"))
    + f"), k as (select *, row_number() over (order by score desc, feature) rk from s) select feature, {r('score',5)} as score, rk::integer as \"rank\", rk <= 2 as selected from k",
)
def univariate_regression(load):
    return _rounded(select.univariate_f(load("lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], k=2).drop("p_value"), 5)


def _mi(c):
    cuts = ", ".join(f"quantile_cont({c},{i / 10}) q{i}" for i in range(1, 10))
    bin_ = " + ".join(f"(case when {c} >= q{i} then 1 else 0 end)" for i in range(1, 10))
    return f"""select '{c}' as feature, sum(o/n*ln(o*n/(px*py))) as score from (select *, sum(o) over (partition by x) px, sum(o) over (partition by y) py, sum(o) over () n from
      (select x, label y, count(*)::double o from (select {bin_} as x, label from t, (select {cuts} from t)) group by 1,2))"""


@query(
    "mutual_information",
    f"with t as ({embedding_sql(4, True)}), s as ({' union all '.join(_mi(f'e{i}') for i in range(4))}), k as (select *, row_number() over (order by score desc, feature) rk from s) select feature, {r('score')} as score, rk::integer as \"rank\", rk <= 2 as selected from k",
)
def mutual_information(load):
    return _rounded(select.mutual_information(embedding_columns(load, 4, True), "label", ["e0", "e1", "e2", "e3"], k=2))


@query(
    "knn_information",
    f"""with x as (select vec_id, label, 'e' || i as feature, embedding[i + 1]::double as v from embeddings, range(64) t(i) where label is not null),
      c as (select *, count(*) over (partition by feature, label) n from x),
      near as (select a.feature, a.vec_id, a.v, a.n, list_sort(list(abs(a.v - b.v)))[least(3, a.n - 1)] as d
        from c a join c b on a.feature = b.feature and a.label = b.label and a.vec_id <> b.vec_id group by a.feature, a.vec_id, a.v, a.n),
      m as (select near.feature, near.vec_id, near.n, count(*) m from near join c on c.feature = near.feature and c.n > 1 and (abs(c.v - near.v) < near.d or c.v = near.v) group by near.feature, near.vec_id, near.n),
      h as (select i, sum(case when i > 1 then 1::double / (i - 1) else 0 end) over (order by i) - 0.5772156649015329 as p from range(1, 1000001) t(i)),
      s as (select feature, greatest(0, any_value(all_rows.p) + avg(hk.p) - avg(hn.p) - avg(hm.p)) as score
        from m join h hm on hm.i = m.m join h hn on hn.i = m.n join h hk on hk.i = least(3, m.n - 1)
        join h all_rows on all_rows.i = (select count(*) from c where n > 1 and feature = 'e0') group by feature),
      k as (select *, row_number() over (order by score desc, feature) rk from s)
      select feature, {r('score')} as score, rk::integer as "rank", rk <= 5 as selected from k""",
)
def knn_information(load):
    return _rounded(select.knn_information(embedding_columns(load, 64, True), "label", E64, k=5))


def _chi(c):
    return f"select '{c}' as feature, sum(s*s/nn)*sum(nn)/sum(s)-sum(s) as score from (select count(*)::double nn, sum({c}-lo+1e-6) s from t, (select min({c}) lo from t) group by label)"


@query(
    "chi_square_selection",
    f"with t as ({embedding_sql(4, True)}), s as ({' union all '.join(_chi(f'e{i}') for i in range(4))}), k as (select *, row_number() over (order by score desc, feature) rk from s) select feature, {r('score',5)} as score, rk::integer as \"rank\", rk <= 2 as selected from k",
)
def chi_square_selection(load):
    return _rounded(select.chi_square_score(embedding_columns(load, 4, True), "label", ["e0", "e1", "e2", "e3"], k=2).drop("p_value"), 5)


@query("rfe")
def rfe(load):
    return select.rfe(document_features(load), "quality", DOC, keep=2)


@query("rfecv")
def rfecv(load):
    return select.rfecv(document_features(load), "quality", ["doc_id"], DOC)


@query("select_from_model")
def select_from_model(load):
    return select.select_from_forest(document_features(load), "quality", DOC)


_CF = ["n_chars", "twice", "doc_id"]


@query(
    "correlation_filter",
    f"""with t as (select n_chars, 2*n_chars + length(lang) as twice, doc_id from documents), c as (select abs(corr(n_chars,twice)) ab, abs(corr(n_chars,doc_id)) ac, abs(corr(twice,doc_id)) bc, var_pop(n_chars) va, var_pop(twice) vb from t)
    select 'n_chars' as feature, {r('(ab+ac)/2')} as score, not (ab > 0.95 and va < vb) as selected from c union all select 'twice', {r('(ab+bc)/2')}, not (ab > 0.95 and va >= vb) from c union all select 'doc_id', {r('(ac+bc)/2')}, true from c""",
)
def correlation_filter(load):
    df = load("documents").select("n_chars", (2 * F.col("n_chars") + F.length("lang")).alias("twice"), "doc_id")
    return _rounded(select.correlation_filter(df, _CF))


@query("vif_filter", f"with t as ({embedding_sql(2)}), c as (select 1/(1-pow(corr(e0,e1),2)) v from t) select 'e0' as feature, {r('v')} as score, v <= 5 as selected from c union all select 'e1', {r('v')}, v <= 5 from c")
def vif_filter(load):
    return _rounded(select.select_features(embedding_columns(load, 2), "vif", features=["e0", "e1"]))


@query(
    "pca_scaled",
    f"""with t as ({embedding_sql(2)}), c as (select abs(corr(e0,e1)) c, count(*)::double n from t) select 1::integer as component, {r('(1+c)*n/(n-1)')} as eigenvalue, {r('(1+c)/2')} as explained_ratio, {r('(1+c)/2')} as cumulative_ratio from c
    union all select 2, {r('(1-c)*n/(n-1)')}, {r('(1-c)/2')}, {r('1')} from c""",
)
def pca_scaled(load):
    return _rounded(red.reduce_dimensions(embedding_columns(load, 2), "pca", columns=["e0", "e1"])[0].drop("loadings"))


@query("pca_wide")
def pca_wide(load):
    """All 64 embedding columns through the batch moment kernel."""
    df = embedding_columns(load, 64)
    return red.pca(df, [f"e{i}" for i in range(64)], 5)[1].select("vec_id", *[f"pc{i}" for i in range(1, 6)])


@query("factor_analysis")
def factor_analysis(load):
    return red.factor_analysis(embedding_columns(load, 64), E64, 2)[0]


@query(
    "truncated_svd",
    f"""with t as ({embedding_sql(2)}), s as (select sum(e0*e0) a, sum(e1*e1) b, sum(e0*e1) c from t), l as (select (a+b)/2+sqrt(pow((a-b)/2,2)+c*c) l1, (a+b)/2-sqrt(pow((a-b)/2,2)+c*c) l2 from s)
    select 1::integer as component, {r('sqrt(l1)',5)} as singular_value from l union all select 2, {r('sqrt(l2)',5)} from l""",
)
def truncated_svd(load):
    return _rounded(red.truncated_svd(embedding_columns(load, 2), ["e0", "e1"])[0].select("component", "singular_value"), 5)


@query("fast_ica")
def fast_ica(load):
    return red.fast_ica(embedding_columns(load, 64), E64, 2)[1].select("vec_id", "ic1", "ic2")


@query("mds")
def mds(load):
    return red.mds(embedding_columns(load, 64), ["vec_id"], E64)


@query("isomap")
def isomap(load):
    return red.isomap(embedding_columns(load, 64), "vec_id", E64)


@query("nmf")
def nmf(load):
    return red.nmf(embedding_columns(load, 64), E64, 3)[1].select("vec_id", "nmf1", "nmf2", "nmf3")


@query("lda")
def lda(load):
    df = embedding_columns(load, 64).select("vec_id", *[(F.col(c) * 10).alias(c) for c in E64])
    return red.lda_topics(df, ["vec_id"], E64, 2)[1]
