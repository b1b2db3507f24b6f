"""Catalogue: whole-text rule packs, function context, IR lines and the graphs built from them.

Source snippets are appended to every document's whole text; each names the document's own id.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import rules as R
from auditloom.functions import text as T
from auditloom.operators import graph, lines as L, matches as M, rollups
from auditloom.plans import prescan
from auditloom.plans.base import (
    CATALOGUE, FUNCTION_SQL, flat, line_context_sql, lines_sql, matches_sql, planted, planted_sql, q, query,
    strip_sql,
)

FEED_CODE = """use pyth_sdk_solana::PriceFeed;
pub fn read_@ID@(ctx: Context<Read>) -> Result<u64> {
    let price_feed = load_price_feed_from_account_info(&ctx.accounts.oracle)?;
    let p = price_feed.get_price_no_older_than(60)?; // then get_price( again
    require!(p.conf > 0 && p.status == PriceStatus::Trading, ErrorCode::BadPrice);
    Ok(oracle_price as u64)
}
fn raw_@ID@(feed: &AccountInfo) { let v = get_price_unchecked(feed); let e = get_ema_price(feed); }
fn board_@ID@(a: AggregatorAccountData) {
    let d: SwitchboardDecimal = a.get_result()?;
    a.check_staleness(1)?; a.latest_confirmed_round
}
fn last_@ID@() { let s = pull_feed; chainlink::Update_Price(1); Price { value: 1 } }"""

FLOW_CODE = """pub fn send_@ID@(ctx: Context<Send>, amount: u64) -> Result<()> {
    require!(amount > 0, ErrorCode::Zero);
    token::transfer(CpiContext::new(prog, Transfer {
        from: ctx.accounts.src.to_account_info(),
        to: ctx.accounts.dst_@ID@.to_account_info(),
    }), amount)?;
    token_2022::mint_to(ctx, 5)
}
fn move_@ID@(a: &AccountInfo, b: &AccountInfo) {
    system_program::transfer(CpiContext::new(p, system_program::Transfer { from: a, to: b }), 10)?;
    **a.try_borrow_mut_lamports()? -= amount * 2;
    **b.lamports.borrow_mut()? += amount;
    vault.deposit(amount); // pool.withdraw(amount)
    pool.unstake (amount);
}
pub fn deposit(x: u64) { token::close_account(ctx)?; }
fn end_@ID@() { token::burn(ctx, 1)?; invoke_signed(&ix, accs, seeds)?; invoke(&ix, accs)?; associated_token::create(c) }"""

STATE_CODE = """pub enum Status_@ID@ { Open, Active, Closed }
pub fn close_@ID@(ctx: Context<Close>) -> Result<()> {
    require!(ctx.accounts.pool.status == Status_@ID@::Open, ErrorCode::NotOpen);
    if pool.state == Open { pool.status = Status_@ID@::Active; }
    let p = Pool { status: Closed.into() };
    token::close_account(ctx.accounts.close())?;
    let rent = Rent::get()?.minimum_balance(8);
    **src.lamports.borrow_mut() = 0;
    src.assign(&system_program::ID);
}
fn drain_@ID@(src: &AccountInfo, authority: &Signer) {
    let t = dst.lamports() + src.lamports();
    **dst.try_borrow_mut_lamports()? = t;
    let cpi = CloseAccount { account: src };
    spl_token::instruction::close_account(x)?;
    if rent.is_exempt(1, 2) { rent_epoch = 0; }
    assert!(pool.phase == Phase::End, Err::Bad);
}"""

ACCOUNT_CODE = """#[derive(Accounts)]
pub struct Init_@ID@<'info> {
    #[account(init_if_needed, payer = admin, space = 8 + 32, seeds = [b"vault", admin.key().as_ref(), &[1]], bump = v.bump)]
    pub vault: Account<'info, Vault>,
    #[account(mut, has_one = authority, constraint = pool.id == @ID@, close = admin)]
    pub pool: Account<'info, Pool>,
    #[account(mut)]
    pub other: Account<'info, Pool>,
    #[account(seeds = [b"cfg", ], bump)]
    pub cfg: UncheckedAccount<'info>,
    pub owner_key: AccountInfo<'info>,
    #[account(signer, address = crate::ID)]
    pub admin: Signer<'info>,
}
fn native_@ID@(accounts: &[AccountInfo]) {
    let payer = next_account_info(iter)?;
    let dest = next_account_info( iter )?;
    if !payer.is_signer || dest.owner == program_id { return; }
    if dest.key == expected && dest.is_writable { x += 1; }
    let n = a.checked_add(b).unwrap(); let y = z as u8; pool.acc_reward_per_share;
    AccountMeta::new_readonly(*dest.key, true);
}
fn plain_@ID@() { let account_info = 1; }"""

CODE = [FEED_CODE, FLOW_CODE, STATE_CODE, ACCOUNT_CODE]

IR_CODE = """fn main_@ID@() -> () {
    _1 = helper_@ID@(move _2) -> [return: bb1, unwind: bb2];
    assert(!move (_3.1), "overflow") -> [success: bb3, unwind: bb4];
    goto -> bb012;
    _5 = core::panicking::panic(const "x");
}
pub fn helper_@ID@(_1: u64) -> u64 {
    switchInt(move _2) -> [0: bb1, otherwise: bb7];
    unsafe { *p = &*helper_@ID@(_1) };
    _6 = move(_1); _7 = std::process::abort();
}"""

CODE_SQL = f"f AS ({planted_sql(CODE)})"


def code(spark, sf_dir):
    return planted(spark, sf_dir, CODE)


def _hits(rules) -> str:
    return f"WITH {CODE_SQL}, hits AS ({matches_sql('f', rules)})"


def _flag(text: str, regex: str) -> str:
    return f"regexp_matches({text}, {q(regex)})"


TEXT_RULES = [R.Rule("year", "info", r"\b(?:19|20)\d\d\b"), R.Rule("shout", "info", r"[!?]{2,}"),
              R.Rule("phone", "info", r"\+?\d[\d -]{7,}\d"), R.Rule("call", "info", r"\b\w+::\w+\(", needles=("::",))]


@query("text_matches", f"{_hits(TEXT_RULES)} SELECT repo, path, rule, line, length(before) AS \"offset\", "
                       f"m AS matched, {line_context_sql()} AS context FROM hits")
def text_matches(spark, sf_dir):
    hits = M.scan_matches(code(spark, sf_dir), TEXT_RULES)
    return flat(hits, "repo", "path", "rule", "line", "offset", M.matched().alias("matched"),
                M.line_context().alias("context"))


GUARDED = [R.Rule("close", "info", r"close_account"), R.Rule("transfer", "info", r"::transfer\b")]
GUARDS = {"mentions_amount": r"amount", "has_require": r"require!"}


@query("segment_guards", f"{_hits(GUARDED)} SELECT repo, path, rule, line, " + ", ".join(
    f"{_flag(FUNCTION_SQL, regex)} AS {name}" for name, regex in GUARDS.items()) + " FROM hits")
def segment_guards(spark, sf_dir):
    hits = M.with_function_context(M.scan_matches(code(spark, sf_dir), GUARDED), GUARDS)
    return flat(hits, "repo", "path", "rule", "line", *GUARDS)


_PRECEDING = """CASE WHEN length(before) > 500 AND contains(substr(before, 1, length(before) - 500), chr(10))
    THEN chr(10) || string_split(substr(before, 1, length(before) - 500), chr(10))[-1]
         || substr(before, length(before) - 499) ELSE before END"""


@query("nearby_guards", f"{_hits(GUARDED)} SELECT repo, path, rule, line, {_flag(_PRECEDING, R.TRANSITION_GUARD)} "
                        f"AS has_guard FROM hits")
def nearby_guards(spark, sf_dir):
    hits = M.scan_matches(code(spark, sf_dir), GUARDED)
    return flat(M.with_nearby_context(hits, {"has_guard": R.TRANSITION_GUARD}), "repo", "path", "rule", "line",
                "has_guard")


@query("comment_skip", f"{_hits(R.PRICE_FEED_GENERIC)} SELECT repo, path, rule, line FROM hits "
                       "WHERE NOT contains(prefix, '//')")
def comment_skip(spark, sf_dir):
    hits = M.scan_matches(code(spark, sf_dir), R.PRICE_FEED_GENERIC)
    return flat(M.skip_commented(hits), "repo", "path", "rule", "line")


def _family(name: str, rules, guards, skip="") -> str:
    flags = ", ".join(f"{_flag(FUNCTION_SQL, guards[f])} AS {f}" if f in guards else f"NULL::BOOLEAN AS {f}"
                      for f in R.PYTH_GUARDS)
    return (f"SELECT repo, path, '{name}' AS type, rule AS pattern, line, {line_context_sql()} AS context, {flags} "
            f"FROM ({matches_sql('f', rules)}) {skip}")


@query("pack_price_feeds", f"WITH {CODE_SQL} {_family('pyth', R.PRICE_FEED_PYTH, R.PYTH_GUARDS)} UNION ALL "
       f"{_family('switchboard', R.PRICE_FEED_SWITCHBOARD, R.SWITCHBOARD_GUARDS)} UNION ALL "
       + _family("generic_oracle", R.PRICE_FEED_GENERIC, {}, "WHERE NOT contains(prefix, '//')"))
def pack_price_feeds(spark, sf_dir):
    return flat(M.price_feeds(code(spark, sf_dir)))


_STATEMENT = strip_sql("""prefix || m || CASE WHEN contains(after, ';')
    THEN substr(after, 1, least(500, position(';' IN after))) ELSE substr(after, 1, 300) END""")


def _account(side: str) -> str:
    pattern = q(rf"{side}\s*:\s*([^,}}]+)")
    return (f"CASE WHEN regexp_matches(st, {pattern}) "
            f"THEN substr({strip_sql(f'regexp_extract(st, {pattern}, 1)')}, 1, 100) END")


def _moves_sql(rules) -> str:
    return f"{_hits(rules)}, s AS (SELECT *, {_STATEMENT} AS st FROM hits)"


@query("pack_token_moves", f"""{_moves_sql(R.TOKEN_MOVES)} SELECT repo, path, rule AS type, line,
    substr(st, 1, 400) AS context, {_account('from')} AS source_account, {_account('to')} AS dest_account,
    {_flag(FUNCTION_SQL, R.AMOUNT_GUARD)} AS has_amount_validation FROM s""")
def pack_token_moves(spark, sf_dir):
    return flat(M.token_moves(code(spark, sf_dir)))


@query("pack_system_transfers", f"""{_moves_sql(R.SYSTEM_TRANSFERS)} SELECT repo, path, rule AS type, line,
    substr(st, 1, 400) AS context, {_account('from')} AS source_account, {_account('to')} AS dest_account FROM s""")
def pack_system_transfers(spark, sf_dir):
    return flat(M.system_transfers(code(spark, sf_dir)))


_BALANCE = q(R.BALANCE_WRITES[0].regex)


def _balance(group: int) -> str:
    return f"CASE WHEN rule_no = 0 THEN regexp_extract(m, {_BALANCE}, {group}) END"


@query("pack_balance_writes", f"""{_hits(R.BALANCE_WRITES)} SELECT repo, path, rule AS type, line,
    {line_context_sql()} AS context, {_balance(1)} AS account, {_balance(2)} AS operator,
    substr({strip_sql(_balance(3))}, 1, 100) AS amount_expression FROM hits""")
def pack_balance_writes(spark, sf_dir):
    return flat(M.balance_writes(code(spark, sf_dir)))


_VAULT = rf"""SELECT repo, path, rule AS type, line, {line_context_sql()} AS context FROM hits
    WHERE NOT contains(prefix, '//')
      AND NOT regexp_matches({line_context_sql()}, '^\s*(?:pub\s+)?(?:fn|async\s+fn)\s+')"""


@query("pack_vault_calls", f"{_hits(R.VAULT_CALLS)} {_VAULT}")
def pack_vault_calls(spark, sf_dir):
    return flat(M.vault_calls(code(spark, sf_dir)))


@query("value_flow_union", f"""WITH {CODE_SQL}, v AS (SELECT repo, rule FROM ({matches_sql(
    'f', R.TOKEN_MOVES + R.SYSTEM_TRANSFERS + R.BALANCE_WRITES)}) UNION ALL SELECT repo, type FROM (
    WITH hits AS ({matches_sql('f', R.VAULT_CALLS)}) {_VAULT}))
    SELECT repo, rule AS type, count(*) AS flows FROM v GROUP BY ALL""")
def value_flow_union(spark, sf_dir):
    return flat(M.value_flows(code(spark, sf_dir)).groupBy("repo", "type").agg(F.count(F.lit(1)).alias("flows")))


_NEW_STATE = (f"CASE WHEN rule_no = 0 THEN regexp_extract(m, {q(R.STATE_TRANSITIONS[0].regex)}, 2) "
              f"ELSE regexp_extract(m, {q(R.STATE_TRANSITIONS[1].regex)}, 1) END")
_TRANSITIONS = f"""SELECT repo, path, 'state_transition' AS type, line, {line_context_sql()} AS context,
    {_NEW_STATE} AS new_state, {_flag(_PRECEDING, R.TRANSITION_GUARD)} AS has_guard"""


@query("pack_state_transitions", f"{_hits(R.STATE_TRANSITIONS)} {_TRANSITIONS} FROM hits")
def pack_state_transitions(spark, sf_dir):
    return flat(M.state_transitions(code(spark, sf_dir)))


def _optional(text: str, regex: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {q(regex)}) THEN regexp_extract({text}, {q(regex)}, 1) END"


@query("pack_state_guards", f"""{_hits(R.STATE_GUARDS)} SELECT repo, path, 'state_guard' AS type, line,
    substr({strip_sql('m')}, 1, 300) AS context, {_optional('m', r'==\s*(\w+(?:::\w+)?)')} AS expected_state,
    {_optional('m', r',\s*(\w+(?:::\w+)?)\s*\)$')} AS error_code FROM hits""")
def pack_state_guards(spark, sf_dir):
    return flat(M.state_guards(code(spark, sf_dir)))


@query("pack_close_calls", f"""{_hits(R.CLOSE_CALLS)} SELECT repo, path, rule AS type, line, {line_context_sql()}
    AS context, {_flag(FUNCTION_SQL, R.CLOSE_GUARDS['has_authority_check'])} AS has_authority_check FROM hits""")
def pack_close_calls(spark, sf_dir):
    return flat(M.close_calls(code(spark, sf_dir)))


_NEAR = "substr(before, greatest(length(before) - 499, 1)) || m || substr(after, 1, 500)"


@query("pack_rent_checks", f"""{_hits(R.RENT_CHECKS)} SELECT repo, path, rule AS type, line, {line_context_sql()}
    AS context FROM hits WHERE {_flag(_NEAR, R.RENT_NEARBY)}""")
def pack_rent_checks(spark, sf_dir):
    return flat(M.rent_checks(code(spark, sf_dir)))


@query("pack_cpi_calls", f"""{_hits(R.CPI_CALLS)} SELECT repo, path, rule AS type, line, {line_context_sql()}
    AS raw_call, target AS target_program, m AS "function" FROM hits""")
def pack_cpi_calls(spark, sf_dir):
    return flat(M.cpi_calls(code(spark, sf_dir)))


_SEED = R.Rule("anchor_seeds_constraint", "info", R.SEED_CONSTRAINT)


@query("pack_seed_constraints", f"""{_hits([_SEED])} SELECT repo, path, rule AS type, line,
    array_to_string(list_filter(list_transform(string_split(regexp_extract(m, {q(_SEED.regex)}, 1), ','),
        lambda s: {strip_sql('s')}), lambda s: s <> ''), ' | ') AS seeds,
    CASE WHEN regexp_extract(m, {q(_SEED.regex)}, 2) = '' THEN 'auto' ELSE regexp_extract(m, {q(_SEED.regex)}, 2) END
        AS bump, substr(m, 1, 200) AS raw_constraint FROM hits""")
def pack_seed_constraints(spark, sf_dir):
    return flat(M.seed_constraints(code(spark, sf_dir)))


# The checking engine has no backreference: it captures both types and compares them.
_TWIN = R.STRUCTURAL[0].pattern.replace(r"\1", r"(\w+)")
_STRUCTURAL_SQL_RULES = [R.Rule("anchor-v2-duplicate-mutable", "warning", _TWIN)] + R.STRUCTURAL[1:]
_BY_RULE = "[" + ", ".join(q(rule.severity) for rule in R.STRUCTURAL) + "]"
_MESSAGES = "[" + ", ".join(q(rule.message) for rule in R.STRUCTURAL) + "]"
_STRUCT = """CASE WHEN contains(before, 'struct ') THEN string_split(before, 'struct ')[-1] ELSE before END || m
    || string_split(after, chr(10) || '}')[1]"""


@query("pack_structural", f"""{_hits(_STRUCTURAL_SQL_RULES)} SELECT repo, path, rule,
    {_BY_RULE}[rule_no + 1] AS severity, {_MESSAGES}[rule_no + 1] AS message, line, substr(m, 1, 200) AS snippet
    FROM hits WHERE NOT (rule = 'missing-has-one-authority' AND {_flag(_STRUCT, r'has_one\s*=')})
    AND NOT (rule_no = 0 AND regexp_extract(m, {q(_TWIN)}, 1) <> regexp_extract(m, {q(_TWIN)}, 2))""")
def pack_structural(spark, sf_dir):
    return flat(M.structural_matches(code(spark, sf_dir)))


SEED_CALLS = R.Rule("seeds", "info", r"f\(&\[[^;]*\]\);")
SEED_PROBES = ['f(&[b"a", x.key(1, 2), &[3, [4, 5]], @ID@]);', "f(&[a]);", "f(&[ m(n{o, p}, q), , r ]);", "f(&[]);"]
_SEED_RESULTS = ["b\"a\" | x.key(1, 2) | &[3, [4, 5]] | @ID@", "a", "m(n{o, p}, q) | r", ""]


@query("split_seeds", f"""WITH f AS ({planted_sql(SEED_PROBES)}) SELECT repo, path,
    replace([{', '.join(q(s) for s in _SEED_RESULTS)}][1 + seq % 4], '@ID@', CAST(seq AS VARCHAR)) AS seeds
    FROM f WHERE contains(content, 'f(&[')""")
def split_seeds(spark, sf_dir):
    hits = M.scan_matches(planted(spark, sf_dir, SEED_PROBES), [SEED_CALLS])
    argument = F.regexp_extract(M.matched(), r"(?s)^f\((.*)\);$", 1)
    return flat(hits, "repo", "path", T.split_seeds(argument).alias("seeds"))


# --- functions, attributes -------------------------------------------------------------------------

_FN = R.Rule("function", "info", r"(?m)^[ \t]*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?fn\s+\w+")
_FUNCTIONS = rf"""hits AS ({matches_sql('f', [_FN])}), fns AS (SELECT repo, path, line,
    substr(content, length(before) + 1, coalesce(lead(length(before)) OVER (PARTITION BY repo, path ORDER BY length(before)),
        length(content)) - length(before)) AS body, regexp_extract(m, 'fn\s+(\w+)', 1) AS "function" FROM hits)"""


@query("function_segments", f"WITH {CODE_SQL}, {_FUNCTIONS} SELECT * FROM fns")
def function_segments(spark, sf_dir):
    return flat(M.functions(code(spark, sf_dir)), "repo", "path", "line", "body", "function")


_UPTO = f"string_split_regex(body, {q(R.NATIVE_DRAIN_LINE)})[1]"


@query("pack_native_close", f"""WITH {CODE_SQL}, {_FUNCTIONS}, c AS (SELECT repo, path, 'native_close' AS type,
    "function", line + CASE WHEN {_flag('body', R.NATIVE_DRAIN_LINE)}
        THEN length({_UPTO}) - length(replace({_UPTO}, chr(10), '')) ELSE 0 END AS line,
    {_flag('body', R.NATIVE_ZEROING)} AS has_data_zeroing, {_flag('body', R.NATIVE_REASSIGN)} AS has_owner_reassign
    FROM fns WHERE {_flag('body', R.NATIVE_DRAIN)})
    SELECT *, NOT has_data_zeroing OR NOT has_owner_reassign AS revival_risk FROM c""")
def pack_native_close(spark, sf_dir):
    return flat(M.native_close_risk(M.functions(code(spark, sf_dir))))


_BINDING = q(r"let\s+(\w+)\s*=\s*next_account_info\s*\(\s*(\w+)\s*\)")


@query("account_fields", rf"""WITH {CODE_SQL}, {_FUNCTIONS}, n AS (SELECT repo, path, line, body, "function",
    unnest(xs) AS name, unnest(range(1, len(xs) + 1)) AS position
    FROM (SELECT *, regexp_extract_all(body, {_BINDING}, 1) AS xs FROM fns))
    SELECT repo, path, line, "function" || '_accounts' AS struct_name, position, name, 'AccountInfo' AS type,
        regexp_matches(body, name || '\.is_signer') AS signer, regexp_matches(body, name || '\.is_writable') AS mutable,
        regexp_extract_all(body, name || '\.owner\s*==\s*([^\s;]+)', 1)[1] AS owner,
        array_to_string(regexp_extract_all(body, name || '\.key\s*==\s*([^\s;]+)', 1), ' | ') AS key_checks FROM n""")
def account_fields(spark, sf_dir):
    return flat(M.native_account_fields(M.functions(code(spark, sf_dir))))


ATTRIBUTE = R.Rule("attribute", "info", r"#\[account\([^\n]*\)\]")


def attributes(spark, sf_dir):
    hits = M.scan_matches(code(spark, sf_dir), [ATTRIBUTE])
    return hits.select("repo", "path", "line", M.matched().alias("attribute"))


def _list(regex: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(m, {q(regex)}, 1), "
            f"lambda s: {strip_sql('s')}), ' | ')")


def _value(regex: str) -> str:
    return strip_sql(_optional("m", regex))


_CONSTRAINTS = rf"""SELECT repo, path, line, {_flag('m', r'\bmut\b')} AS mutable, {_flag('m', r'\bsigner\b')} AS signer,
    {_flag('m', r'\binit(?:_if_needed)?\b')} AS init, {_flag('m', r'\binit_if_needed\b')} AS init_if_needed,
    {_value(r'close\s*=\s*(\w+)')} AS close, {_list(r'has_one\s*=\s*(\w+)')} AS has_one,
    array_to_string(list_filter(list_transform(string_split(regexp_extract(m, 'seeds\s*=\s*\[([^\]]*)\]', 1), ','),
        lambda s: {strip_sql('s')}), lambda s: s <> ''), ' | ') AS seeds,
    CASE WHEN contains(m, 'bump') THEN coalesce(nullif(regexp_extract(m, 'bump\s*(?:=\s*(\w+[.\w]*))?', 1), ''), 'auto')
        END AS bump,
    {_value(r'payer\s*=\s*(\w+)')} AS payer, {_value(r'space\s*=\s*([^,\]]+)')} AS space,
    {_value(r'address\s*=\s*([^,\]]+)')} AS address, {_list(r'constraint\s*=\s*([^,\]]+)')} AS "constraint" FROM hits"""


@query("constraint_table", f"{_hits([ATTRIBUTE])} {_CONSTRAINTS}")
def constraint_table(spark, sf_dir):
    return flat(M.constraint_table(attributes(spark, sf_dir)).drop("attribute"))


_PAIRS = ", ".join(
    [f"CASE WHEN {n} THEN '{n}=true' END" for n in ("mutable", "signer", "init", "init_if_needed")]
    + [f"CASE WHEN \"{n}\" <> '' THEN '{n}=' || to_json(string_split(\"{n}\", ' | ')) END" for n in ("has_one", "seeds", "constraint")]
    + [f"'{n}=' || {n}" for n in ("close", "bump", "payer", "space", "address")])


@query("constraint_map", f"""{_hits([ATTRIBUTE])}, c AS ({_CONSTRAINTS}) SELECT repo, path, line, concat_ws('; ', {_PAIRS}) AS constraints FROM c""")
def constraint_map(spark, sf_dir):
    entries = F.transform(F.map_entries("constraints"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return flat(M.constraint_map(attributes(spark, sf_dir)), "repo", "path", "line", F.array_join(entries, "; ").alias("constraints"))


@query("constraint_counts", f"""{_hits([ATTRIBUTE])}, c AS ({_CONSTRAINTS}) SELECT repo,
    count(*) FILTER (mutable) AS n_mutable, count(*) FILTER (signer) AS n_signer, count(*) FILTER (init) AS n_init,
    count(*) FILTER (init_if_needed) AS n_init_if_needed, count(*) FILTER (has_one <> '') AS n_has_one,
    count(*) FILTER (seeds <> '') AS n_seeds, count(*) FILTER ("constraint" <> '') AS n_constraint,
    count(close) AS n_close, count(bump) AS n_bump, count(payer) AS n_payer, count(space) AS n_space,
    count(address) AS n_address FROM c GROUP BY repo""")
def constraint_counts(spark, sf_dir):
    return flat(rollups.constraint_counts(M.constraint_table(attributes(spark, sf_dir))))


STATE_ACCOUNT = R.Rule("account", "info", r"pub\s+\w+\s*:\s*Account\s*<\s*'[^,]+,\s*\w+\s*>")
_ACCOUNT = r"pub\s+(\w+)\s*:\s*Account\s*<\s*'[^,]+,\s*(\w+)\s*>"


@query("authority_coverage", rf"""{_hits([STATE_ACCOUNT])}, s AS (SELECT *, {_STRUCT} AS body FROM hits)
    SELECT repo, path, regexp_extract(body, '^(\w+)', 1) AS struct_name, regexp_extract(m, {q(_ACCOUNT)}, 1) AS account,
        regexp_extract(m, {q(_ACCOUNT)}, 2) AS account_type, authority_field,
        regexp_matches(body, 'has_one\s*=\s*' || authority_field || '\b') AS has_one_constraint,
        regexp_matches(body, 'pub\s+' || authority_field || '\s*:\s*Signer') AS signer_validated
    FROM s, (SELECT unnest({R.AUTHORITY_NAMES}) AS authority_field)""")
def authority_coverage(spark, sf_dir):
    body = M.struct_context()
    accounts = M.scan_matches(code(spark, sf_dir), [STATE_ACCOUNT]).select(
        "repo", "path", F.regexp_extract(body, r"^(\w+)", 1).alias("struct_name"),
        F.regexp_extract(M.matched(), _ACCOUNT, 1).alias("account"),
        F.regexp_extract(M.matched(), _ACCOUNT, 2).alias("account_type"),
        F.regexp_extract_all(body, F.lit(r"has_one\s*=\s*(\w+)"), F.lit(1)).alias("has_one"),
        F.regexp_extract_all(body, F.lit(r"pub\s+(\w+)\s*:\s*Signer"), F.lit(1)).alias("signers"))
    return flat(graph.authority_coverage(accounts))


# --- state graphs ----------------------------------------------------------------------------------

ENUM = R.Rule("enum", "info", r"enum\s+\w+\s*\{[^}]*\}")


def enums(corpus):
    hits = M.scan_matches(corpus, [ENUM])
    names = F.regexp_extract_all(F.regexp_extract(M.matched(), r"\{([^}]*)\}", 1), F.lit(r"\w+"), F.lit(0))
    return hits.select("repo", "path", F.regexp_extract(M.matched(), r"enum\s+(\w+)", 1).alias("enum_name"),
                       names.alias("variants"))


_GRAPH = rf"""{_hits(R.STATE_TRANSITIONS)}, tr AS ({_TRANSITIONS} FROM hits),
    eh AS ({matches_sql('f', [ENUM])}),
    en AS (SELECT repo, path, regexp_extract(m, 'enum\s+(\w+)', 1) AS enum_name,
        regexp_extract_all(regexp_extract(m, '\{{([^}}]*)\}}', 1), '\w+') AS variants FROM eh),
    resolved AS (SELECT repo, path, enum_name, string_split(new_state, '::')[-1] AS target, has_guard, line,
        list_filter(variants, lambda v: regexp_matches(context, '==\s*(?:' || enum_name || '::)?' || v || '\b'))[1]
            AS source
        FROM en JOIN tr USING (repo, path) WHERE list_contains(variants, string_split(new_state, '::')[-1])
        AND (NOT contains(new_state, '::') OR string_split(new_state, '::')[1] = enum_name))"""


def resolved(spark, sf_dir):
    corpus = code(spark, sf_dir)
    return enums(corpus), graph.resolve_transitions(enums(corpus), M.state_transitions(corpus))


@query("transition_graph", f"{_GRAPH} SELECT DISTINCT repo, path, enum_name, source, target FROM resolved "
                           "WHERE source IS NOT NULL")
def transition_graph(spark, sf_dir):
    return flat(graph.transition_graph(resolved(spark, sf_dir)[1]))


BARE_CODE = [
    snippet.replace("require!(ctx.accounts.pool.status", "check(ctx.accounts.pool.status").replace(
        "if pool.state == Open", "check(pool.state == Open);")
    for snippet in CODE
]


@query("unguarded_transitions", f"""{_GRAPH.replace(planted_sql(CODE), planted_sql(BARE_CODE))} SELECT repo, path, enum_name, coalesce(source, 'unknown') AS "from",
    target AS "to", line FROM resolved WHERE NOT has_guard""")
def unguarded_transitions(spark, sf_dir):
    corpus = planted(spark, sf_dir, BARE_CODE)
    return flat(graph.unguarded_transitions(graph.resolve_transitions(enums(corpus), M.state_transitions(corpus))))


@query("terminal_states", f"""{_GRAPH} SELECT repo, path, enum_name, variant FROM (
    SELECT repo, path, enum_name, unnest(variants) AS variant FROM en) n WHERE NOT EXISTS (
    SELECT 1 FROM resolved r WHERE r.repo = n.repo AND r.path = n.path AND r.enum_name = n.enum_name
        AND r.source = n.variant)""")
def terminal_states(spark, sf_dir):
    declared, placed = resolved(spark, sf_dir)
    return flat(graph.terminal_states(declared, graph.transition_graph(placed)))


@query("graph_documents", f"""{_GRAPH}, nodes AS (SELECT repo, path, enum_name, unnest(variants) AS variant FROM en),
    spread AS (SELECT n.*, (SELECT array_to_string(list_sort(list(DISTINCT target)), ',') FROM resolved r
        WHERE r.repo = n.repo AND r.path = n.path AND r.enum_name = n.enum_name AND r.source = n.variant) AS targets
        FROM nodes n)
    SELECT repo, path, enum_name, string_agg(variant || '=' || coalesce(targets, ''), ' | ' ORDER BY variant)
        AS transitions, string_agg(variant, ' | ' ORDER BY variant) FILTER (targets IS NULL) AS terminal_states
    FROM spread GROUP BY ALL""")
def graph_documents(spark, sf_dir):
    declared, placed = resolved(spark, sf_dir)
    docs = graph.graph_documents(declared, graph.transition_graph(placed))
    entries = F.transform(F.map_entries("transitions"),
                          lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))
    return flat(docs.withColumn("transitions", entries))


# --- IR lines --------------------------------------------------------------------------------------

_HEADER = q(R.IR_HEADER)
_IR = rf"""f AS ({planted_sql([IR_CODE])}), lines AS ({lines_sql('f')}), h AS (SELECT *, {strip_sql('text')} AS t FROM lines),
    a AS (SELECT *, last_value(CASE WHEN regexp_matches(t, {_HEADER}) THEN regexp_extract(t, {_HEADER}, 1) END
        IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line) AS "function" FROM h)"""
_OWNER = "coalesce(\"function\", 'unknown')"


def _ir(kind: str, severity: str, message: str, regexes: list[str]) -> str:
    test = " OR ".join(_flag("t", regex) for regex in regexes)
    return (f"SELECT repo, path, line, \"function\", '{kind}' AS type, '{severity}' AS severity, {message} AS message, "
            f"substr(t, 1, 200) AS snippet FROM a WHERE {test}")


_IR_HITS = " UNION ALL ".join([
    _ir("panic_path", "warning", f"'Panic/abort path detected in ' || {_OWNER}", R.IR_PANIC),
    _ir("unsafe_block", "warning", f"'Unsafe block in ' || {_OWNER}", [R.IR_UNSAFE]),
    _ir("potential_loop", "info", f"'Potential loop detected in ' || {_OWNER} || ' (jump to bb' || "
                                  "CAST(CAST(regexp_extract(t, 'bb([0-9]+)', 1) AS BIGINT) AS VARCHAR) || ')'", R.IR_JUMP),
    _ir("assert_check", "info", f"'Assert/bounds check in ' || {_OWNER}", [R.IR_ASSERT]),
])
_EDGES = rf"""edges AS (SELECT DISTINCT repo, path, "function" AS caller,
    trim(regexp_extract(t, '=\s*(\S+)\(', 1), '&*') AS callee FROM a WHERE "function" IS NOT NULL),
    calls AS (SELECT * FROM edges WHERE callee <> '' AND NOT starts_with(callee, '_')
        AND callee NOT IN ('move', 'const'))"""


def ir_lines(spark, sf_dir, recursion=False):
    return L.attributed_lines(planted(spark, sf_dir, [IR_CODE]), recursion=recursion)


_ATTRIBUTED = f"WITH {_IR} SELECT repo, path, line, \"function\" FROM a"


@query("function_attribution", _ATTRIBUTED)
def function_attribution(spark, sf_dir):
    """Over split lines: the name is carried forward in buckets of lines."""
    lines = L.explode_lines(planted(spark, sf_dir, [IR_CODE]))
    return flat(L.attribute_function(lines, width=8), "repo", "path", "line", "function")


@query("function_attribution_text", _ATTRIBUTED)
def function_attribution_text(spark, sf_dir):
    """Over whole texts: the same rows without a shuffle."""
    return flat(ir_lines(spark, sf_dir), "repo", "path", "line", "function")


_IR_ROWS = f"""WITH {_IR}, {_EDGES} {_IR_HITS} UNION ALL SELECT repo, path, 0, caller, 'recursive_call', 'warning',
    'Direct recursion detected in ' || caller, '' FROM calls WHERE caller = callee"""


@query("ir_line_scan", _IR_ROWS)
def ir_line_scan(spark, sf_dir):
    return flat(L.scan_ir_lines(ir_lines(spark, sf_dir, recursion=True)))


@query("call_edges", f"WITH {_IR}, {_EDGES} SELECT * FROM calls")
def call_edges(spark, sf_dir):
    return flat(graph.call_edges(ir_lines(spark, sf_dir)))


@query("recursion", f"WITH {_IR}, {_EDGES} SELECT * FROM calls WHERE caller = callee")
def recursion(spark, sf_dir):
    return flat(graph.direct_recursion(graph.call_edges(ir_lines(spark, sf_dir))))


@query("scan_stats", f"""WITH {_IR}, {_EDGES}, hits AS ({_IR_HITS}),
    fn AS (SELECT repo, path, count(*) FILTER (regexp_matches(t, {_HEADER})) AS total_functions FROM a GROUP BY ALL),
    c AS (SELECT repo, path, count(*) FILTER (type = 'panic_path') AS panic_paths,
        count(*) FILTER (type = 'unsafe_block') AS unsafe_blocks,
        count(*) FILTER (type = 'potential_loop') AS potential_loops FROM hits GROUP BY ALL),
    r AS (SELECT repo, path, count(*) AS recursive_calls FROM calls WHERE caller = callee GROUP BY ALL)
    SELECT repo, path, total_functions, coalesce(panic_paths, 0) AS panic_paths,
        coalesce(unsafe_blocks, 0) AS unsafe_blocks, coalesce(potential_loops, 0) AS potential_loops,
        coalesce(recursive_calls, 0) AS recursive_calls
    FROM fn LEFT JOIN c USING (repo, path) LEFT JOIN r USING (repo, path)""")
def scan_stats(spark, sf_dir):
    lines = ir_lines(spark, sf_dir)
    return flat(rollups.scan_stats(L.scan_ir_lines(ir_lines(spark, sf_dir, recursion=True)), lines))


# --- the composed job ------------------------------------------------------------------------------

MIXED = CODE + [IR_CODE]
_STRUCTURAL_LEADS = CATALOGUE["pack_structural"].sql.replace(planted_sql(CODE), planted_sql(MIXED))
_IR_LEADS = CATALOGUE["ir_line_scan"].sql.replace(planted_sql([IR_CODE]), planted_sql(MIXED))
_LEADS = f"""SELECT repo, 'ast-grep' AS source, rule, severity, message, path AS file, line, snippet FROM ({_STRUCTURAL_LEADS})
    UNION ALL SELECT repo, 'mir', type, severity, message, path, line, snippet FROM ({_IR_LEADS})"""
_DOMAIN_WORDS = ", ".join(f"({q(d)}, [{', '.join(q(w) for w in words)}]::VARCHAR[])"
                          for d, words in R.LEAD_KEYWORDS.items())


@query("prescan_leads", _LEADS)
def prescan_leads(spark, sf_dir):
    return flat(prescan.prescan_leads(planted(spark, sf_dir, MIXED)))


@query("prescan_domains", f"""WITH l AS ({_LEADS}) SELECT repo, domain, source, severity, count(*) AS leads
    FROM l, (VALUES {_DOMAIN_WORDS}) AS k(domain, words) WHERE len(words) = 0 OR len(list_filter(words,
    lambda w: contains(lower(concat_ws(' ', message, rule, file, snippet)), w))) > 0 GROUP BY ALL""")
def prescan_domains(spark, sf_dir):
    return flat(prescan.domain_leads(prescan.prescan_leads(planted(spark, sf_dir, MIXED))))
