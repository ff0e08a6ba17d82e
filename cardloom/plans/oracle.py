"""The derived tables and the priced fact in SQL, as WITH clauses that oracle statements start with.

The fact is written as an independent computation: prices come from VALUES lists, fees from one expression for each
payer, in another shape than the DataFrame plan.
"""

from __future__ import annotations

from ..sources import fees


def _values(rows) -> str:
    def one(x) -> str:
        return "null" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::double" if isinstance(x, float) else repr(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def _tables() -> str:
    groups = _values((k, i, *v) for i, (k, v) in enumerate(fees.GROUPS.items()))
    base = _values((p, g, float(r), float(fees.FIXED[p])) for p, rates in fees.BASE_RATES.items() for g, r in zip(fees.GROUPS, rates, strict=True))
    costs = _values((k, i, *map(float, v)) for i, (k, v) in enumerate(fees.ISSUER_COSTS.items()))
    number = lambda c: f"(cast(substr({c}, 7) as int) % 12)"
    product = "case c_mktsegment when 'BUILDING' then 'credit_standard' when 'FURNITURE' then 'credit_premium' when 'MACHINERY' then 'commercial' else 'debit' end"
    bounds, total = [], 0.0
    for name, share in fees.TIERS[:-1]:
        total += share
        bounds.append(f"when rnk <= cast(floor({total!r} * n + 0.5) as bigint) then '{name}'")
    small = f"region = 'domestic' and product in {fees.SMALL_PRODUCTS!r} and mcc_group in {fees.SMALL_GROUPS!r}"
    return f"""
groups(mcc_group, pos, group_margin, base_elasticity, blended_mdr_rate, online_share, fraud_risk, dispute_rate) as (
  select * from (values {groups}) v),
base(product, mcc_group, base_rate, fixed_cop) as (select * from (values {base}) v),
issuer_costs(product, product_pos, rewards, funding, loss, processing) as (select * from (values {costs}) v),
grid as (
  select product, mcc_group, channel, region,
         round(base_rate + case channel when 'cnp' then {fees.CNP_ADD} else 0 end + case region when 'cross_border' then {fees.CROSS_BORDER_ADD} else 0 end, 6)::double as rate,
         fixed_cop,
         case when {small} then {fees.SMALL_MAX}::double end as small_ticket_max_cop,
         case when {small} then {fees.SMALL_RATE}::double end as small_ticket_rate,
         case when {small} then {fees.SMALL_FIXED}::double end as small_ticket_fixed_cop,
         date '{fees.VALID_FROM}' as valid_from, cast(null as date) as valid_to
  from base, (values ('cp'), ('cnp')) c(channel), (values ('domestic'), ('cross_border')) r(region)),
tx as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(o_orderdate as date) as txn_date, o_custkey as cardholder_id,
         l_partkey as merchant_id, l_suppkey as shop_id, cast(c_nationkey as varchar) as issuer_id,
         cast(s_nationkey as varchar) as acquirer_id, {product} as product, p_brand as mcc, g.mcc_group,
         case when l_linestatus = 'O' then 'cnp' else 'cp' end as channel,
         l_linestatus = 'O' and l_returnflag = 'N' as tokenized, n_regionkey = 0 as cross_border,
         c_nationkey = s_nationkey as on_us, cast(floor(l_extendedprice) as bigint) as amount_cop,
         l_discount >= 0.1 as fraud_flag, l_returnflag = 'R' as chargeback_flag
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
       join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
       join part on l_partkey = p_partkey join groups g on g.pos = {number("p_brand")}),
merchants as (
  select p_partkey as merchant_id, p_brand as mcc, g.mcc_group,
         case p_size % 3 when 0 then 'cp' when 1 then 'cnp' else 'mixed' end as channel,
         case {" ".join(bounds)} else '{fees.TIERS[-1][0]}' end as size_tier, p_retailprice / 1000 as size_weight,
         cast(p_partkey % 25 as varchar) as acquirer_id,
         greatest(0.005, least(0.9, g.group_margin * (0.75::double + p_size / 100.0::double))) as sector_margin,
         case when rnk <= cast(floor(0.1 * n + 0.5) as bigint) and p_size % 2 = 0 then 'icpp' else 'blended' end as pricing_model
  from (select *, row_number() over (order by p_retailprice desc, p_partkey) as rnk, count(*) over () as n from part) p
       join groups g on g.pos = {number("p_brand")}),
cardholders as (
  select c_custkey as cardholder_id, cast(c_nationkey as varchar) as issuer_id, {product} as product,
         case when c_acctbal < 2000 then 'low' when c_acctbal < 7000 then 'mid' else 'high' end as spend_segment from customer),
issuers as (
  select cast(n_nationkey as varchar) as issuer_id, case when n_regionkey % 2 = 0 then 'bank' else 'fintech' end as issuer_type,
         n_name as country, case when n_regionkey % 2 = 0 then cast(n_regionkey as varchar) end as bank_group from nation),
acquirers as (
  select cast(n_nationkey as varchar) as acquirer_id,
         case when n_regionkey = 0 then 'foreign' when n_nationkey % 2 = 0 then 'bank' else 'aggregator' end as acquirer_type,
         n_name as country, case when n_nationkey % 2 = 0 then cast(n_regionkey as varchar) end as bank_group,
         case n_nationkey % 3 when 0 then 'blended' when 1 then 'icpp' else 'mixed' end as pricing_model from nation),
mccs as (
  select distinct p_brand as mcc, 'Code ' || substr(p_brand, 7) as mcc_name, g.mcc_group, group_margin as sector_margin,
         base_elasticity, blended_mdr_rate
  from part join groups g on g.pos = {number("p_brand")})"""


def _fact() -> str:
    (ia, iu, ix), (aa, au, ax) = fees.NETWORK["issuer"], fees.NETWORK["acquirer"]
    return f"""
charged as (
  select t.*, cast(t.amount_cop as double) as a, if(t.cross_border, 1, 0) as x, m.pricing_model, g.blended_mdr_rate,
         k.region, case when t.amount_cop <= k.small_ticket_max_cop then k.small_ticket_rate else k.rate end as cell_rate,
         case when t.amount_cop <= k.small_ticket_max_cop then k.small_ticket_fixed_cop else k.fixed_cop end as cell_fixed,
         c.rewards, c.funding, c.loss, c.processing
  from tx t join merchants m using (merchant_id) join groups g on g.mcc_group = t.mcc_group
       join grid k on k.product = t.product and k.mcc_group = t.mcc_group and k.channel = t.channel
            and k.region = if(t.cross_border, 'cross_border', 'domestic')
       join issuer_costs c on c.product = t.product),
split as (
  select *, a * cell_rate + cell_fixed as interchange_cop, a * {ia} + {iu} + x * (a * {ix}) as issuer_network_fee_cop,
         a * {aa} + {au} + x * (a * {ax}) as acquirer_network_fee_cop,
         a * {ia} + a * {aa} as network_assessment_cop, {iu + au}::double as network_authorization_cop,
         x * (a * {ix} + a * {ax}) as network_cross_border_cop from charged),
fct as (
  select * exclude (a, x, cell_rate, cell_fixed, rewards, funding, loss, processing, blended_mdr_rate),
         cast(date_trunc('month', txn_date) as date) as txn_month,
         issuer_network_fee_cop + acquirer_network_fee_cop as network_revenue_cop, mdr_cop,
         interchange_cop - issuer_network_fee_cop as issuer_gross_cop,
         mdr_cop - interchange_cop - acquirer_network_fee_cop as acquirer_gross_cop,
         a * rewards as rewards_cop, a * funding as funding_cop, a * loss as credit_loss_cop, a * processing as issuer_processing_cop,
         if(fraud_flag and not chargeback_flag, a, 0) as fraud_loss_cop,
         a * {fees.PROCESSING_RATE} + {fees.PROCESSING_FIXED} as acquirer_processing_cop, if(chargeback_flag, a, 0) as chargeback_cop,
         interchange_cop - issuer_network_fee_cop - a * (rewards + funding + loss + processing)
           - if(fraud_flag and not chargeback_flag, a, 0) as issuer_contribution_cop,
         mdr_cop - interchange_cop - acquirer_network_fee_cop - (a * {fees.PROCESSING_RATE} + {fees.PROCESSING_FIXED}) as acquirer_contribution_cop,
         mdr_cop + if(chargeback_flag, a, 0) as merchant_cost_cop
  from (select *, case pricing_model when 'icpp' then interchange_cop + acquirer_network_fee_cop + a * {fees.MARKUP_RATE} + {fees.MARKUP_FIXED}
                  else a * (blended_mdr_rate + x * {fees.BLENDED_CROSS_BORDER}) end as mdr_cop from split) s)"""


TABLES = "with" + _tables()
FACT = TABLES + "," + _fact()


def over_tables(select: str, *ctes: str) -> str:
    return ",\n".join([TABLES, *ctes]) + "\n" + select


def over_fact(select: str, *ctes: str) -> str:
    return ",\n".join([FACT, *ctes]) + "\n" + select
