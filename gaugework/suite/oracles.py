"""Counterparts of the registered queries in plain SQL over the given tables.

They are written the direct way (``count(distinct)``, ``median``, one window per question) so that
agreement means something.
"""

from __future__ import annotations

from gaugework.suite import fixtures as X

_TYPED = ("BOOLEAN", "INTEGER", "FLOAT", "DATE", "DATETIME")


def column_counts(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select {i} as position, '{c}' as name, count(*) as row_count, count({c}) as non_null_count,
            count(*) - count({c}) as null_count,
            round(cast(count(*) - count({c}) as double) / count(*), 6) as null_ratio,
            count(distinct {c}) as distinct_count,
            round(cast(count(distinct {c}) as double) / count({c}), 6) as uniqueness_ratio,
            count({c}) - count(distinct {c}) as duplicate_excess_rows,
            count(distinct {c}) = 1 as is_constant, count({c}) = 0 as is_all_null from {table}"""
        for i, c in enumerate(columns)
    )


def numeric_stats(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as name, cast(min({c}) as double) as minimum, cast(max({c}) as double) as maximum,
            round(avg(cast({c} as double)), 4) as mean, round(cast(median({c}) as double), 4) as median,
            round(stddev_pop(cast({c} as double)), 4) as stddev from {table}"""
        for c in columns
    )


def temporal_range(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as name, min(epoch_us({c})) as minimum_us, max(epoch_us({c})) as maximum_us from {table}"
        for c in columns
    )


def text_lengths(table: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""select '{c}' as name, min(length({c})) as min_length, max(length({c})) as max_length,
            round(avg(length({c})), 4) as average_length from {table}"""
        for c in columns
    )


def row_duplicates(source: str, columns: list[str]) -> str:
    return f"""with g as (select count(*) as n from ({source}) s group by {', '.join(columns)})
        select coalesce(sum(n) filter (n > 1), 0)::bigint as duplicate_row_count,
            coalesce(sum(n - 1), 0)::bigint as duplicate_excess_row_count,
            count(*) filter (n > 1) as complete_duplicate_group_count from g"""


def flagged_rows() -> str:
    return f"""select row_id from (select row_id, row_number() over (
        partition by {', '.join(X.CUSTOMER_COLUMNS)} order by row_id) as place from ({_customers()}) m) where place > 1"""


def flagged_values() -> str:
    return f"""select row_id from (select row_id, row_number() over (partition by customer_id order by row_id) as place
        from ({_customers()}) m where customer_id is not null) where place > 1"""


def _customers() -> str:
    return X.for_duckdb(X.MESSY_CUSTOMERS_KEYED)


def text_profile(view: str, columns: tuple[str, ...], table: str) -> str:
    """CTEs ending in ``profile`` for a view whose columns are all text."""
    cells = " union all ".join(f"select {i} as position, '{c}' as name, {c} as value from m" for i, c in enumerate(columns))
    day = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
    counts = ", ".join(f"count(*) filter (kind = '{k}') as valid_{k}" for k in _TYPED)
    inferred = " ".join(f"when strict_{k} = non_null_count then '{k}'" for k in _TYPED)
    stricts = ", ".join(
        f"count(*) filter (kind = '{k}' and value = token and (kind <> 'BOOLEAN' or lower(value) in ('true', 'false')))"
        f" as strict_{k}"
        for k in _TYPED
    )
    parsers = " ".join(f"when valid_{k} / non_null_count >= 0.98 then '{k}'" for k in _TYPED)
    valid = " ".join(f"when '{k}' then valid_{k}" for k in _TYPED)
    return f"""m as ({view}), cells as ({cells}),
        tokens as (select *, trim(value) as token from cells),
        kinds as (select *, case when value is null then null
            when regexp_full_match(token, '0[0-9]+') then 'LEADING_ZERO'
            when lower(token) in ('true', 'false', 'yes', 'no') then 'BOOLEAN'
            when regexp_full_match(token, '[+-]?(0|[1-9][0-9]*)') then 'INTEGER'
            when regexp_full_match(token, '[+-]?(0|[1-9][0-9]*)[.][0-9]+') then 'FLOAT'
            when regexp_full_match(token, '{day}') and try_cast(token as date) is not null then 'DATE'
            when regexp_full_match(token, '{day}T[0-9:]{{8}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})?')
                and try_cast(token as timestamptz) is not null then 'DATETIME' else 'NONE' end as kind from tokens),
        families as (select *, case kind
            when 'BOOLEAN' then 'BOOLEAN_' || case when token = lower(token) then 'LOWER' when token = upper(token)
                then 'UPPER' when token = upper(token[1]) || lower(token[2:]) then 'TITLE' else 'OTHER' end
            when 'DATE' then 'DATE_ISO'
            when 'DATETIME' then case when token like '%Z' then 'DATETIME_Z' when token[-6] in ('+', '-')
                then 'DATETIME_OFFSET' else 'DATETIME_NO_TIMEZONE' end
            else kind || '_' || case token[1] when '+' then 'PLUS' when '-' then 'MINUS' else 'UNSIGNED' end end as family
            from kinds),
        counted as (select position, name, count(*) as row_count, count(value) as non_null_count,
            count(distinct value) as distinct_count, count(*) filter (kind = 'LEADING_ZERO') as leading_zero,
            {counts}, {stricts} from kinds group by position, name),
        typed as (select *, row_count - non_null_count as null_count, non_null_count - distinct_count as excess,
            case when non_null_count = 0 then 'NULL' when leading_zero = non_null_count then 'STRING' {inferred}
                else 'STRING' end as inferred_type,
            case when non_null_count = 0 then 'NULL' when leading_zero * 100 >= non_null_count * 95 then 'STRING'
                {parsers} else 'STRING' end as parser_type from counted),
        profile as (select '{table}' as table_name, *, case parser_type {valid} else 0 end as valid_count,
            case when parser_type in ('NULL', 'STRING') then 0 else non_null_count - case parser_type {valid} end end
                as invalid_count, {_CANDIDATE} as reason from typed)"""


_NAMED = "(lower(name) in ('id', 'identifier', 'uuid', 'guid') or lower(name) like '%\\_id' escape '\\')"
_CANDIDATE = f"""case
    when {_NAMED} and row_count >= 10 and non_null_count / row_count >= 0.95
        and distinct_count / non_null_count >= 0.98 then 'name_signal_thresholds_v0_1'
    when not {_NAMED} and row_count >= 100 and non_null_count / row_count >= 0.99
        and distinct_count / non_null_count >= 0.999 then 'structural_thresholds_v0_1' end"""


def messy_customers() -> str:
    return text_profile(X.for_duckdb(X.MESSY_CUSTOMERS), X.CUSTOMER_COLUMNS, "messy_customers")


def messy_events() -> str:
    return text_profile(X.for_duckdb(X.MESSY_EVENTS), X.EVENT_COLUMNS, "messy_events")


def physical_profile(tables: dict[str, list[tuple[str, str]]]) -> str:
    """CTEs ending in ``profile`` for the given tables, whose types are physical."""
    parts = " union all ".join(
        f"""select '{t}' as table_name, {i} as position, '{c}' as name, '{kind}' as inferred_type, '{kind}' as parser_type,
            count(*) as row_count, count({c}) as non_null_count, count(*) - count({c}) as null_count,
            count(distinct {c}) as distinct_count, count({c}) - count(distinct {c}) as excess,
            case when '{kind}' = 'STRING' then 0 else count({c}) end as valid_count, 0 as invalid_count from {t}"""
        for t, columns in tables.items()
        for i, (c, kind) in enumerate(columns)
    )
    return f"physical as ({parts}), profile as (select *, {_CANDIDATE} as reason from physical)"


def with_ctes(ctes: str, query: str) -> str:
    return f"with {ctes} {query}"


CANDIDATES = """select table_name, position, name, reason, reason like 'name%' as name_signal,
    round(non_null_count / row_count, 6) as completeness, round(distinct_count / non_null_count, 6) as uniqueness
    from profile where reason is not null"""

PROFILING_FINDINGS = f"""
    select 'F-COL-' || position || '-ALL_NULL' as finding_id, 'WARNING' as severity, 'DETECTED' as assertion_level,
        'all_null' as category, null_count as observed, row_count as denominator
        from profile where row_count > 0 and non_null_count = 0
    union all select 'F-COL-' || position || '-CONSTANT_COLUMN', 'INFO', 'DETECTED', 'constant_column', 1, non_null_count
        from profile where distinct_count = 1
    union all select 'F-COL-' || position || '-CANDIDATE-IDENTIFIER', 'INFO', 'INFERRED', 'candidate_identifier', null, null
        from profile where reason is not null
    union all select 'F-DATASET-DUPLICATE-ROWS', 'WARNING', 'DETECTED', 'duplicate_record', sum(n - 1)::bigint, null
        from (select count(*) as n from m group by {', '.join(X.CUSTOMER_COLUMNS)}) having sum(n - 1) > 0"""

QUALITY_FINDINGS_CTE = """quality_findings as (
    select position * 2 as finding_order, 'F-QUALITY-COL-' || position || '-DUPLICATE-IDENTIFIER' as finding_id,
        'duplicate_structural_identifier' as category, 'QUALITY-IDENTIFIER-DUPLICATE-001' as method,
        position, excess as observed, non_null_count as denominator from profile where reason is not null and excess > 0
    union all select position * 2 + 1, 'F-QUALITY-COL-' || position || '-MISSING-IDENTIFIER',
        'structural_identifier_missingness', 'QUALITY-IDENTIFIER-MISSING-001', position, null_count, row_count
        from profile where reason is not null and null_count > 0
    union all select 1099511627776 + position, 'F-QUALITY-COL-' || position || '-MALFORMED-VALUE', 'malformed_value',
        'quality_validity_parser_v0_1', position, invalid_count, non_null_count from profile where invalid_count > 0)"""


def quality_ctes(uncovered: str, row_excess: str, families: str) -> str:
    """CTEs ending in ``dimensions``; the arguments are scalar queries and the biggest-family relation."""
    return f"""biggest as ({families}),
        measures as (select max(row_count) as row_count, count(*) as column_count, sum(row_count) as cells,
            sum(null_count) as nulls, count(reason) as candidates,
            sum(null_count) filter (reason is not null) as candidate_nulls,
            avg(excess / non_null_count) filter (reason is not null) as identifier_rate,
            coalesce(sum(non_null_count) filter (parser_type not in ('NULL', 'STRING')), 0) as typed_values,
            coalesce(sum(invalid_count), 0) as invalid_values,
            coalesce(sum(valid_count) filter (consistent), 0) as consistent_values,
            coalesce(sum(valid_count - biggest) filter (consistent), 0) as inconsistent_values,
            ({uncovered}) as uncovered, ({row_excess}) as row_excess
            from (select p.*, coalesce(b.biggest, 0) as biggest, parser_type not in ('NULL', 'STRING')
                and non_null_count >= 10 and valid_count / non_null_count >= 0.98 as consistent
                from profile p left join biggest b using (position))),
        dimensions as (
            select 0 as dimension_rank, 'structural_completeness' as name, 35 as weight,
                case when candidates > 0 then round_even((1 - candidate_nulls / (row_count * candidates)) * 100, 2) end as score,
                case when candidates > 0 then (row_count * candidates - candidate_nulls)::bigint end as numerator,
                case when candidates > 0 then (row_count * candidates)::bigint end as denominator,
                case when candidates = 0 then 'no_structural_candidate_identifier' end as reason from measures
            union all select 1, 'uniqueness', 25,
                case when candidates > 0
                    then round_even((1 - least(1, 0.8 * identifier_rate + 0.2::double * (uncovered / row_count))) * 100, 2)
                    else round_even((1 - row_excess / row_count) * 100, 2) end,
                (row_count - case when candidates > 0 then uncovered else row_excess end)::bigint, row_count::bigint, null
                from measures
            union all select 2, 'validity', 25,
                case when typed_values > 0 then round_even((1 - invalid_values / typed_values) * 100, 2) end,
                case when typed_values > 0 then (typed_values - invalid_values)::bigint end,
                case when typed_values > 0 then typed_values::bigint end,
                case when typed_values = 0 then 'no_typed_columns' end from measures
            union all select 3, 'consistency', 15,
                case when consistent_values > 0
                    then round_even((1 - inconsistent_values / consistent_values) * 100, 2) end,
                case when consistent_values > 0 then (consistent_values - inconsistent_values)::bigint end,
                case when consistent_values > 0 then consistent_values::bigint end,
                case when consistent_values = 0 then 'no_recognized_format_family' end from measures)"""


DIMENSIONS = """select name, weight, score, case when reason is null then 'APPLICABLE' else 'NOT_APPLICABLE' end
    as applicability, reason, numerator, denominator from dimensions"""
SCORE = """select round_even(sum(score * weight) / sum(weight) filter (score is not null), 0)::bigint as overall_score,
    (select round_even((1 - nulls / cells) * 100, 2) from measures) as observed_completeness from dimensions"""

TEXT_FAMILIES = """select position, max(n) as biggest from (
    select f.position, family, count(*) as n from families f join profile p using (position)
    where f.kind = p.parser_type group by f.position, family) group by position"""
PHYSICAL_FAMILIES = "select position, valid_count as biggest from profile"


def messy_quality() -> str:
    """The positional definition: repeated rows whose identifier does not repeat with them."""
    uncovered = f"""select count(*) from ({flagged_rows()}) r where row_id not in ({flagged_values()})"""
    row_excess = f"select count(*) from ({flagged_rows()}) r"
    return f"{messy_customers()}, {quality_ctes(uncovered, row_excess, TEXT_FAMILIES)}"


def _ends(phrases: list[str]) -> str:
    listed = " or ".join(f"' ' || words like '% {p}'" for p in phrases)
    return (
        f"(({listed}) and words not in ('application state', 'order state', 'workflow state', 'sales region',"
        " 'business region'))"
    )


NAME_TOKENS = """list_filter(string_split_regex(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')),
    '[_\\-\\s]+'), lambda w: w <> '')"""

GOVERNANCE_CTES = f"""
    worded as (select *, array_to_string({NAME_TOKENS}, ' ') as words from profile),
    first_pass as (select *,
        coalesce(reason like 'name%', false) and (words in ('id', 'identifier', 'uuid', 'guid') or words like '% id') as is_id,
        inferred_type in ('DATE', 'DATETIME') as is_time,
        {_ends(['email', 'phone', 'phone number', 'telephone', 'mobile', 'mobile phone'])}
            and not regexp_matches(words, '\\b(campaign|sent|count|call)\\b') as is_contact,
        {_ends(['country', 'country code', 'city', 'postal code', 'postcode', 'zip code', 'latitude', 'longitude'])}
            or words in ('region', 'state', 'province') as is_place,
        {_ends(['age', 'birth date', 'date of birth', 'dob', 'gender'])} as is_demo,
        inferred_type in ('INTEGER', 'FLOAT') and {_ends(['revenue', 'amount', 'price', 'cost', 'salary'])} as is_money,
        inferred_type in ('INTEGER', 'FLOAT')
            and {_ends(['revenue', 'amount', 'price', 'cost', 'quantity', 'count', 'score'])} as is_metric,
        inferred_type = 'STRING'
            and {_ends(['description', 'comment', 'comments', 'note', 'notes', 'free text'])} as is_free from worded),
    second_pass as (select *,
        inferred_type in ('STRING', 'BOOLEAN') and row_count >= 20 and non_null_count >= 10 and distinct_count >= 2
            and distinct_count / non_null_count <= 0.2 and not is_id and not is_free and not is_metric as is_cat,
        (is_demo or is_place) and not is_id and not is_contact
            and count(*) filter (is_demo or is_place) over (partition by table_name) >= 2 as is_quasi,
        is_id or is_contact or is_demo as is_personal from first_pass),
    classes as (
        select *, 0 as category_rank, 'IDENTIFIER' as category, 'GOV-ID-001' as rule_id, 3 as total from second_pass where is_id
        union all select *, 1, 'QUASI_IDENTIFIER', 'GOV-QUASI-001', 1 from second_pass where is_quasi
        union all select *, 2, 'CONTACT_INFORMATION', 'GOV-CONTACT-001', 2 from second_pass where is_contact
        union all select *, 3, 'GEOGRAPHIC_INFORMATION', 'GOV-GEO-001', 2 from second_pass where is_place
        union all select *, 4, 'DEMOGRAPHIC_INFORMATION', 'GOV-DEMO-001', 3 from second_pass where is_demo
        union all select *, 5, 'FINANCIAL_INFORMATION', 'GOV-FIN-001', 3 from second_pass where is_money
        union all select *, 6, 'TEMPORAL_FIELD', 'GOV-TEMP-001', case when words in ('date', 'datetime', 'timestamp',
            'time', 'created at', 'updated at') then 3 else 1 end from second_pass where is_time
        union all select *, 7, 'FREE_TEXT', 'GOV-TEXT-001', 3 from second_pass where is_free
        union all select *, 8, 'BUSINESS_METRIC', 'GOV-METRIC-001', 3 from second_pass where is_metric
        union all select *, 9, 'CATEGORICAL_DIMENSION', 'GOV-CAT-001', 2 from second_pass where is_cat
        union all select *, 10, 'POTENTIAL_PERSONAL_DATA', 'GOV-PERSONAL-001', 1 from second_pass where is_personal),
    signal_rules as (select * from (values
        ('IDENTIFIER', 'COLUMN_NAME', 2), ('IDENTIFIER', 'UNIQUENESS', 1), ('QUASI_IDENTIFIER', 'COLUMN_NAME', 1),
        ('CONTACT_INFORMATION', 'COLUMN_NAME', 2), ('GEOGRAPHIC_INFORMATION', 'COLUMN_NAME', 2),
        ('DEMOGRAPHIC_INFORMATION', 'COLUMN_NAME', 2), ('DEMOGRAPHIC_INFORMATION', 'PRIMITIVE_TYPE', 1),
        ('FINANCIAL_INFORMATION', 'COLUMN_NAME', 2), ('FINANCIAL_INFORMATION', 'PRIMITIVE_TYPE', 1),
        ('TEMPORAL_FIELD', 'COLUMN_NAME', 2), ('TEMPORAL_FIELD', 'PRIMITIVE_TYPE', 1), ('FREE_TEXT', 'COLUMN_NAME', 2),
        ('FREE_TEXT', 'PRIMITIVE_TYPE', 1), ('BUSINESS_METRIC', 'COLUMN_NAME', 2),
        ('BUSINESS_METRIC', 'PRIMITIVE_TYPE', 1), ('CATEGORICAL_DIMENSION', 'PRIMITIVE_TYPE', 1),
        ('CATEGORICAL_DIMENSION', 'VALUE_DISTRIBUTION', 1), ('POTENTIAL_PERSONAL_DATA', 'COLUMN_NAME', 1))
        as rules (category, source, strength)),
    signals as (select c.*, source, strength,
        'S-GOV-COL-' || position || '-' || c.category || '-' || source as signal_id from classes c
        join signal_rules r on c.category = r.category
        where not (c.category = 'TEMPORAL_FIELD' and source = 'COLUMN_NAME' and total < 3))"""

CLASSES = """select table_name, 'C-GOV-col:' || position || '-' || category as classification_id,
    'col:' || position as column_id, category, rule_id, case when total >= 3 then 'MEDIUM' else 'LOW' end as confidence
    from classes"""

RECOMMENDATION_CTES = """
    candidates as (
        select 'P0' as priority, 0 as source_rank, 'QUALITY' as source, 0 as rule, 'DATA_QUALITY' as category,
            'REC-QUALITY-DUPLICATE-ID-001' as rule_id, position as place, finding_id, position
            from quality_findings where category = 'duplicate_structural_identifier'
        union all select 'P1', 0, 'QUALITY', 1, 'DATA_QUALITY', 'REC-QUALITY-MALFORMED-001', position, finding_id, position
            from quality_findings where category = 'malformed_value'
        union all select 'P1', 1, 'GOVERNANCE', 2, 'PRIVACY_REVIEW', 'REC-GOV-PERSONAL-001', 1000000000,
            'F-GOV-col:' || position || '-POTENTIAL_PERSONAL_DATA', position from second_pass where is_personal
        union all select 'P1', 1, 'GOVERNANCE', 3, 'GOVERNANCE', 'REC-GOV-QUASI-001', 1000000000,
            'F-GOV-col:' || position || '-QUASI_IDENTIFIER', position from second_pass where is_quasi),
    recommended as (select *, 'R-' || rule_id || '-' || finding_id as recommendation_id, row_number() over (
        order by priority, source_rank, rule, place, finding_id) as rank from candidates)"""


def messy_rules() -> str:
    """Profile, quality findings, governance and recommendations of the dirty customers."""
    return f"{messy_customers()}, {QUALITY_FINDINGS_CTE}, {GOVERNANCE_CTES}, {RECOMMENDATION_CTES}"
