"""Citations generated from the star-schema tables: known records, and references to them with known faults.

The statement is plain SQL that Spark and other engines read alike. ``variant`` tells the
fault: 1 no DOI, 2 year off by one, 3 a letter too many in the surname, 4 the DOI of another
record, 5 a truncated DOI, 7 no DOI and a subtitle; the others are clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CITATIONS_SQL = """
with b as (
 select o.o_orderkey as k, cast(o.o_orderkey % 10 as int) as variant, c.c_custkey, c.c_mktsegment as seg, l.l_partkey, p.p_name, s.s_suppkey
 from orders o join customer c on o.o_custkey = c.c_custkey
 join (select l_orderkey, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
 join part p on p.p_partkey = l.l_partkey join supplier s on s.s_suppkey = l.l_suppkey),
t as (select k, variant, c_custkey,
 split_part('Smith,Jansen,Garcia,Nguyen,Brown,de Vries,Keller,Okafor,Silva,Novak,Moreau,Larsen,Rossi,Tanaka,Ahmed,van der Berg', ',', cast(c_custkey % 16 as int) + 1) as surname,
 substr('ABCDEFGHJKLMNPRST', cast(s_suppkey % 17 as int) + 1, 1) as initial,
 cast(1990 + k % 30 as int) as year,
 concat(upper(substr(p_name,1,1)), substr(p_name,2), ' ',
  split_part('adaptive,robust,causal,spatial,digital,urban,clinical,neural,thermal,social,genomic,fiscal,marine,rural,lexical,ethical', ',', cast(k % 16 as int) + 1), ' ',
  split_part('inference,planning,learning,resilience,migration,turnover,diffusion,governance,imaging,tillage,parsing,auditing,forecasting,screening,routing,grading', ',', cast(floor(k / 16) % 16 as int) + 1), ' under ',
  split_part('drought,stress,reform,uncertainty,scarcity,growth,noise,pressure', ',', cast(floor(k / 256) % 8 as int) + 1)) as title,
 concat('Journal of ', upper(substr(seg,1,1)), lower(substr(seg,2)), ' Research') as container,
 cast(k % 60 + 1 as string) as volume, cast(k % 4 + 1 as string) as issue,
 concat(cast(k % 400 + 1 as string), '-', cast(k % 400 + 2 + l_partkey % 20 as string)) as pages,
 concat('10.5555/bib.', cast(k as string)) as doi from b)
select k, variant, c_custkey, title, surname, initial, year, container, volume, issue, pages, doi,
 concat(case when variant = 3 then concat(surname, 'e') else surname end, ', ', initial, '. (', cast(case when variant = 2 then year + 1 else year end as string), '). ', title,
  case when variant = 7 then ': A second look' else '' end, '. ', container, ', ', volume, '(', issue, '), ', pages, '.',
  case when variant in (1, 7) then '' when variant = 4 then concat(' https://doi.org/10.5555/bib.', cast(k + 1 as string))
       when variant = 5 then ' https://doi.org/10.5555/bib.' else concat(' https://doi.org/', doi) end) as raw_reference
from t
"""

_TABLES = ("orders", "customer", "lineitem", "part", "supplier")


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, variant, c_custkey, the fields of the true record, and raw_reference."""
    sql = CITATIONS_SQL
    views = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES}
    for name, df in views.items():
        sql = sql.replace(f"from {name} ", f"from {{{name}}} ").replace(f"join {name} ", f"join {{{name}}} ").replace(f"from {name} group", f"from {{{name}}} group")
    return spark.sql(sql, **{n: df for n, df in views.items() if f"{{{n}}}" in sql})
