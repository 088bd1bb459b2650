"""Hypothesis tests."""

from pyspark.sql import functions as F

from gaugewell.catalog.registry import query, r
from gaugewell.functions.columns import tidy
from gaugewell.operators import hypothesis as h


def _rounded(df, digits=5, drop=("p_value", "significant")):
    return df.drop(*drop).select(*[tidy(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in drop])


@query("t_one_sample", f"select event_type, count(*)::bigint as n, {r('avg(value)',5)} as mean, {r('(avg(value)-10)/(stddev_samp(value)/sqrt(count(*)))',5)} as statistic, {r('(avg(value)-10)/stddev_samp(value)',5)} as effect_size from events group by 1")
def t_one_sample(load):
    return _rounded(h.t_test_one_sample(load("events"), "value", 10.0, by=["event_type"]).select("event_type", "n", "mean", "statistic", "effect_size"))


_TWO = "select count(case when l_returnflag='A' then 1 end) n1, count(case when l_returnflag='N' then 1 end) n2, avg(case when l_returnflag='A' then l_extendedprice end) m1, avg(case when l_returnflag='N' then l_extendedprice end) m2, var_samp(case when l_returnflag='A' then l_extendedprice end) v1, var_samp(case when l_returnflag='N' then l_extendedprice end) v2 from lineitem"


@query("t_independent_pooled", f"with s as ({_TWO}), q as (select *, ((n1-1)*v1+(n2-1)*v2)/(n1+n2-2) p from s) select {r('(m1-m2)/sqrt(p*(1.0/n1+1.0/n2))',5)} as statistic, {r('n1+n2-2',5)} as df, {r('(m1-m2)/sqrt(p)',5)} as effect_size from q")
def t_independent_pooled(load):
    return _rounded(h.t_test_independent(load("lineitem"), "l_extendedprice", "l_returnflag", "A", "N").select("statistic", "df", "effect_size"))


@query("t_independent_welch", f"with s as ({_TWO}) select {r('(m1-m2)/sqrt(v1/n1+v2/n2)',5)} as statistic, {r('pow(v1/n1+v2/n2,2)/(pow(v1/n1,2)/(n1-1)+pow(v2/n2,2)/(n2-1))',3)} as df from s")
def t_independent_welch(load):
    out = h.t_test_independent(load("lineitem"), "l_extendedprice", "l_returnflag", "A", "N", equal_var=False)
    return out.select(tidy(F.col("statistic"), 5).alias("statistic"), tidy(F.col("df"), 3).alias("df"))


@query("t_paired", f"select count(*)::bigint as n, {r('avg(d)/(stddev_samp(d)/sqrt(count(*)))',5)} as statistic, {r('avg(d)/stddev_samp(d)',5)} as effect_size from (select l_discount - l_tax d from lineitem)")
def t_paired(load):
    return _rounded(h.t_test_paired(load("lineitem"), "l_discount", "l_tax").select("n", "statistic", "effect_size"))


def _ranked(x, part=""):
    return f"rank() over ({part} order by {x}) + (count(*) over ({part or ''} {'partition by' if not part else ','} {x}) - 1)/2.0"


@query(
    "mann_whitney",
    f"""with t as (select l_returnflag g, l_quantity x from lineitem where l_returnflag in ('A','N')), k as (select g, {_ranked('x')} rk, x from t),
    s as (select count(case when g='A' then 1 end) n1, count(case when g='N' then 1 end) n2, sum(case when g='A' then rk end) r1, median(case when g='A' then x end) a, median(case when g='N' then x end) b from k)
    select n1::bigint as n1, n2::bigint as n2, {r('r1-n1*(n1+1)/2.0',3)} as statistic, {r('1-2*(r1-n1*(n1+1)/2.0)/(1.0*n1*n2)',6)} as effect_size, {r('a',3)} as median1, {r('b',3)} as median2 from s""",
)
def mann_whitney(load):
    out = h.mann_whitney_u(load("lineitem"), "l_quantity", "l_returnflag", "A", "N")
    return out.select("n1", "n2", tidy(F.col("statistic"), 3).alias("statistic"), tidy(F.col("effect_size"), 6).alias("effect_size"), tidy(F.col("median1"), 3).alias("median1"), tidy(F.col("median2"), 3).alias("median2"))


@query("chi_square_fit_unexpected", "select count(*)::bigint as n, 2::bigint as k, true as infinite, 0.0::double as p_value from events")
def chi_square_fit_unexpected(load):
    """Categories occur that have no expected share."""
    out = h.chi_square_fit(load("events"), "event_type", {"click": 1, "view": 2})
    return out.select("n", "k", (F.col("statistic") == F.lit(float("inf"))).alias("infinite"), "p_value")


@query(
    "mann_whitney_nullable_by",
    f"""with t as (select nullif(l_linestatus,'O') s, l_returnflag g, l_quantity x from lineitem where l_returnflag in ('R','N')), k as (select s, g, {_ranked('x', 'partition by s')} rk, x from t),
    a as (select s, count(case when g='R' then 1 end) n1, count(case when g='N' then 1 end) n2, sum(case when g='R' then rk end) r1 from k group by s)
    select s, n1::bigint as n1, n2::bigint as n2, {r('r1-n1*(n1+1)/2.0',3)} as statistic from a""",
)
def mann_whitney_nullable_by(load):
    rows = load("lineitem").withColumn("s", F.nullif(F.col("l_linestatus"), F.lit("O")))
    return h.mann_whitney_u(rows, "l_quantity", "l_returnflag", "R", "N", by=["s"]).select("s", "n1", "n2", tidy(F.col("statistic"), 3).alias("statistic"))


@query(
    "levene_nullable_by",
    f"""with e as (select nullif(user_id % 3, 0)::varchar b, event_type g, value from events), m as (select b, g, median(value) md from e group by 1, 2), z as (select e.b, e.g, abs(value-md) z from e join m on e.g = m.g and e.b is not distinct from m.b),
    p as (select b, g, count(*)::double n, avg(z) m, var_samp(z) v from z group by 1, 2), s as (select b, sum(n) n, count(*)::double k, sum(n*m*m)-pow(sum(n*m),2)/sum(n) q, sum((n-1)*v) w from p group by 1)
    select b, n::bigint as n, k::bigint as k, {r('(q/(k-1))/(w/(n-k))',5)} as statistic from s""",
)
def levene_nullable_by(load):
    rows = load("events").withColumn("b", F.nullif(F.col("user_id") % 3, F.lit(0)).cast("string"))
    return h.levene(rows, "value", "event_type", by=["b"]).select("b", "n", "k", tidy(F.col("statistic"), 5).alias("statistic"))


@query(
    "wilcoxon",
    f"""with t as (select round(l_discount - l_tax, 10) d from lineitem), k as (select d, {_ranked('abs(d)')} rk from t where d <> 0),
    s as (select sum(case when d>0 then rk end) wp, sum(case when d<0 then rk end) wm from k), c as (select count(*)::double n, count(case when d=0 then 1 end)::bigint z from t)
    select n::bigint as n, z as zeros, {r('wp',2)} as w_plus, {r('wm',2)} as w_minus, {r('least(wp,wm)',2)} as statistic, {r('(least(wp,wm)-n*(n+1)/4)/sqrt(n*(n+1)*(2*n+1)/24)/sqrt(n)',6)} as effect_size from s, c""",
)
def wilcoxon(load):
    df = load("lineitem").select(F.round(F.col("l_discount") - F.col("l_tax"), 10).alias("d"))
    out = h.wilcoxon_signed_rank(df, "d").drop("p_value", "significant")
    return out.select(*[tidy(F.col(c), 6 if c == "effect_size" else 2).alias(c) if t == "double" else c for c, t in out.dtypes])


@query(
    "kruskal",
    f"""with k as (select event_type g, {_ranked('value')} rk, value from events), t as (select sum(c*c*c-c)::double ties from (select count(*)::hugeint c from events group by value)),
    p as (select g, count(*)::double n, sum(rk) r from k group by g), s as (select sum(n) n, count(*)::double kk, sum(r*r/n) rr from p)
    select n::bigint as n, kk::bigint as k, {r('(12/(n*(n+1))*rr-3*(n+1))/(1-ties/(n*n*n-n))',5)} as statistic, {r('kk-1',5)} as df,
    {r('((12/(n*(n+1))*rr-3*(n+1))/(1-ties/(n*n*n-n))-kk+1)/(n-kk)',7)} as effect_size from s, t""",
)
def kruskal(load):
    out = h.kruskal_wallis(load("events"), "value", "event_type").drop("p_value", "significant")
    return out.select(*[tidy(F.col(c), 7 if c == "effect_size" else 5).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("group_medians", f"select l_returnflag as \"group\", count(*)::bigint as n, {r('median(l_extendedprice)',4)} as median from lineitem group by 1")
def group_medians(load):
    return _rounded(h.group_medians(load("lineitem"), "l_extendedprice", "l_returnflag"), 4)


@query("shapiro_wilk")
def shapiro_wilk(load):
    return h.shapiro_wilk(load("events"), "value", by=["event_type"])


_SK = "avg(pow(value-m,3))/pow(any_value(v),1.5)"


@query(
    "jarque_bera",
    f"""with e as (select event_type, value, avg(value) over (partition by event_type) m, var_pop(value) over (partition by event_type) v from events),
    s as (select event_type, count(*)::bigint n, {_SK} sk, kurtosis_pop(value) ku from e group by 1)
    select event_type, n, {r('sk',5)} as skewness, {r('ku',5)} as kurtosis, {r('n/6.0*(sk*sk+ku*ku/4)',2)} as statistic from s""",
)
def jarque_bera(load):
    out = h.jarque_bera(load("events"), "value", by=["event_type"])
    return out.select("event_type", "n", tidy(F.col("skewness"), 5).alias("skewness"), tidy(F.col("kurtosis"), 5).alias("kurtosis"), tidy(F.col("statistic"), 2).alias("statistic"))


@query(
    "dagostino",
    f"""with e as (select o_totalprice value, avg(o_totalprice) over () m, var_pop(o_totalprice) over () v from orders),
    s as (select count(*)::double n, {_SK} sk, kurtosis_pop(value) ku from e),
    a as (select *, sk*sqrt((n+1)*(n+3)/(6*(n-2))) y, 3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) beta,
      (ku+3-3*(n-1)/(n+1))/sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) x, 6*(n*n-5*n+2)/((n+7)*(n+9))*sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) rb from s),
    b as (select *, sqrt(2*(beta-1))-1 w2, 6+8/rb*(2/rb+sqrt(1+4/(rb*rb))) aa from a),
    c as (select *, asinh(y/sqrt(2/(w2-1)))/sqrt(0.5*ln(w2)) z1, 1+x*sqrt(2/(aa-4)) dn from b),
    d as (select z1, (1-2/(9*aa)-sign(dn)*cbrt((1-2/aa)/abs(dn)))/sqrt(2/(9*aa)) z2 from c)
    select {r('z1',5)} as z_skewness, {r('z2',5)} as z_kurtosis, {r('(z1*z1+z2*z2)',3)} as statistic from d""",
)
def dagostino(load):
    out = h.normal_test(load("orders"), "o_totalprice")
    return out.select(tidy(F.col("z_skewness"), 5).alias("z_skewness"), tidy(F.col("z_kurtosis"), 5).alias("z_kurtosis"), tidy(F.col("statistic"), 3).alias("statistic"))


@query(
    "levene",
    f"""with m as (select event_type, median(value) md from events group by 1), z as (select event_type g, abs(value-md) z from events join m using (event_type)),
    p as (select g, count(*)::double n, avg(z) m, var_samp(z) v from z group by 1), s as (select sum(n) n, count(*)::double k, sum(n*m*m)-pow(sum(n*m),2)/sum(n) b, sum((n-1)*v) w from p)
    select n::bigint as n, k::bigint as k, {r('(b/(k-1))/(w/(n-k))',5)} as statistic, {r('k-1',5)} as df1, {r('n-k',5)} as df2 from s""",
)
def levene(load):
    return _rounded(h.levene(load("events"), "value", "event_type"))


@query(
    "bartlett",
    f"""with p as (select count(*)::double n, var_samp(value) v from events group by event_type), s as (select sum(n) n, count(*)::double k, sum((n-1)*v) sp, sum((n-1)*ln(v)) sl, sum(1/(n-1)) si from p)
    select n::bigint as n, k::bigint as k, {r('((n-k)*ln(sp/(n-k))-sl)/(1+(si-1/(n-k))/(3*(k-1)))',5)} as statistic, {r('k-1',5)} as df from s""",
)
def bartlett(load):
    return _rounded(h.bartlett(load("events"), "value", "event_type"))


@query("fligner")
def fligner(load):
    return h.fligner(load("events"), "value", "event_type")


@query("chi_square_fit", f"with c as (select count(*)::double o from events group by event_type) select sum(o)::bigint as n, count(*)::bigint as k, {r('sum(o*o)*count(*)/sum(o)-sum(o)',5)} as statistic, {r('count(*)-1',5)} as df from c")
def chi_square_fit(load):
    return _rounded(h.chi_square_fit(load("events"), "event_type"))


_CT = """with c as (select l_returnflag a, l_linestatus b, count(*)::double o from lineitem group by 1,2), e as (select a, b, o, sum(o) over (partition by a) rt, sum(o) over (partition by b) ct, sum(o) over () n from c)"""


@query("contingency", f"{_CT} select a, b, o::bigint as observed, rt::bigint as row_total, ct::bigint as column_total, n::bigint as n, {r('rt*ct/n',4)} as expected from e")
def contingency(load):
    return _rounded(h.contingency(load("lineitem"), "l_returnflag", "l_linestatus"), 4)


@query("chi_square_independence", f"{_CT} select any_value(n)::bigint as n, {r('sum(pow(o-rt*ct/n,2)/(rt*ct/n))',5)} as statistic, {r('(count(distinct a)-1)*(count(distinct b)-1)',5)} as df from e")
def chi_square_independence(load):
    return _rounded(h.chi_square_independence(load("lineitem"), "l_returnflag", "l_linestatus"))


@query(
    "chi_square_yates",
    f"""with c as (select quality a, toxic b, count(*)::double o from labels group by 1,2), e as (select o, sum(o) over (partition by a) rt, sum(o) over (partition by b) ct, sum(o) over () n from c)
    select any_value(n)::bigint as n, {r('sum(pow(greatest(abs(o-rt*ct/n)-0.5,0),2)/(rt*ct/n))',5)} as statistic from e""",
)
def chi_square_yates(load):
    return _rounded(h.chi_square_independence(load("labels"), "quality", "toxic").select("n", "statistic"))


@query("fisher_exact", f"select count(case when quality=1 and toxic=1 then 1 end)::bigint as a, count(case when quality=1 and toxic=0 then 1 end)::bigint as b, count(case when quality=0 and toxic=1 then 1 end)::bigint as c, count(case when quality=0 and toxic=0 then 1 end)::bigint as d from labels")
def fisher_exact(load):
    return h.fisher_exact(load("labels"), F.col("quality") == 1, F.col("toxic") == 1).select("a", "b", "c", "d")


@query("fisher_exact_p")
def fisher_exact_p(load):
    return h.fisher_exact(load("orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 250000)


@query("pearson_test", f"select count(*)::bigint as n, {r('corr(l_quantity,l_tax)',6)} as statistic, {r('count(*)-2',6)} as df, {r('corr(l_quantity,l_tax)*sqrt((count(*)-2)/(1-pow(corr(l_quantity,l_tax),2)))',5)} as t, {r('tanh(atanh(corr(l_quantity,l_tax))-1.959963984540054/sqrt(count(*)-3))',5)} as ci_low, {r('tanh(atanh(corr(l_quantity,l_tax))+1.959963984540054/sqrt(count(*)-3))',5)} as ci_high from lineitem")
def pearson_test(load):
    out = h.pearson_test(load("lineitem"), "l_quantity", "l_tax").drop("p_value", "significant")
    return out.select(*[tidy(F.col(c), 6 if c in ("statistic", "df") else 5).alias(c) if t == "double" else c for c, t in out.dtypes])


@query("spearman_test", f"with k as (select {_ranked('l_quantity')} a, {_ranked('l_extendedprice')} b from lineitem) select count(*)::bigint as n, {r('corr(a,b)',6)} as statistic, {r('corr(a,b)*sqrt((count(*)-2)/(1-pow(corr(a,b),2)))',4)} as t from k")
def spearman_test(load):
    out = h.spearman_test(load("lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", tidy(F.col("statistic"), 6).alias("statistic"), tidy(F.col("t"), 4).alias("t"))


@query("kendall_test")
def kendall_test(load):
    return h.kendall_test(load("lineitem"), "l_quantity", "l_extendedprice")


_KENDALL = """with t as (select p_size as x, p_retailprice as y, row_number() over () as i from part), c as (select count(*)::double as n, count(*) * (count(*) - 1) / 2.0 as pairs from t),
 s as (select sum(sign((a.x - b.x) * (a.y - b.y)))::double as s from t a join t b on a.i < b.i),
 u as (select sum(k * (k - 1)) as a, sum(k * (k - 1) * (k - 2)) as b, sum(k * (k - 1) * (2 * k + 5)) as v from (select count(*)::double as k from t group by x)),
 w as (select sum(k * (k - 1)) as a, sum(k * (k - 1) * (k - 2)) as b, sum(k * (k - 1) * (2 * k + 5)) as v from (select count(*)::double as k from t group by y)),
 v as (select (n * (n - 1) * (2 * n + 5) - u.v - w.v) / 18 + u.a * w.a / (2 * n * (n - 1)) + u.b * w.b / (9 * n * (n - 1) * (n - 2)) as var from c, u, w)"""


@query("kendall_all_pairs", f"{_KENDALL} select n::bigint as n, {r('s / (sqrt(pairs - u.a / 2) * sqrt(pairs - w.a / 2))')} as statistic, {r('s / sqrt(var)', 5)} as z from c, s, u, w, v")
def kendall_all_pairs(load):
    """The test's statistic next to a count over all pairs."""
    out = h.kendall_test(load("part"), "p_size", "p_retailprice")
    return out.select("n", tidy(F.col("statistic"), 6).alias("statistic"), tidy(F.col("z"), 5).alias("z"))


_FISHER = """with t as (select count(*) filter (where p and q) as a, count(*) filter (where p and not q) as b, count(*) filter (where q and not p) as c, count(*) filter (where not p and not q) as d
   from (select c_acctbal > 9000 as p, c_mktsegment = 'BUILDING' as q from customer)),
 m as (select *, a + b as r1, c + d as r2, a + c as c1, a + b + c + d as n from t),
 k as (select unnest(range(greatest(0, c1 - r2), least(r1, c1) + 1)) as x, * from m),
 l as (select x, a, lgamma(r1 + 1) + lgamma(r2 + 1) + lgamma(c1 + 1) + lgamma(n - c1 + 1) - lgamma(n + 1) - lgamma(x + 1) - lgamma(r1 - x + 1) - lgamma(c1 - x + 1) - lgamma(r2 - c1 + x + 1) as lp from k),
 o as (select lp as seen from l where x = a)"""


@query("fisher_exact_small", f"{_FISHER} select a, b, c, d, {r('a * d / (b * c)::double')} as statistic, {r('(select sum(exp(lp)) from l, o where lp <= seen + 1e-7)')} as p_value from t")
def fisher_exact_small(load):
    out = h.fisher_exact(load("customer"), F.col("c_acctbal") > 9000, F.col("c_mktsegment") == "BUILDING")
    return out.select("a", "b", "c", "d", tidy(F.col("statistic"), 6).alias("statistic"), tidy(F.col("p_value"), 6).alias("p_value"))


@query("adjusted_p_values")
def adjusted_p_values(load):
    tests = h.t_test_one_sample(load("events"), "value", 10.0, by=["user_id"])
    return h.adjust_p_values(tests.select("user_id", "p_value"))


@query(
    "adjusted_shares",
    f"""with p as (select user_id, avg(case when event_type='error' then 1.0 else 0 end)::double p from events group by 1), m as (select count(*)::double m from p),
    k as (select user_id, p, m, row_number() over (order by p, user_id) i from p, m)
    select user_id, {r('p')} as p, {r('least(1,p*m)')} as p_bonferroni, {r('least(1,max((m-i+1)*p) over (order by i))')} as p_holm,
    {r('least(1,min(p*m/i) over (order by i rows between current row and unbounded following))')} as p_fdr_bh from k""",
)
def adjusted_shares(load):
    """The corrections on observed shares, which have ties and an SQL twin."""
    shares = load("events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("p"))
    out = h.adjust_p_values(shares, "p").drop("reject_fdr_bh")
    return _rounded(out, 6, drop=())
