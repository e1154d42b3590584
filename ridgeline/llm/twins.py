"""DuckDB SQL for the parts of operators that SQL can say: LM base scores, payload digests and base counts of the quality rules."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The reflected CRC-32 polynomial, 0xEDB88320.
POLYNOMIAL = 3988292384


def crc32_sql(octets: str) -> str:
    """CRC-32 of a list of byte values, bit by bit. Each step works on all 32 bits, as an unsigned long."""
    step = "c"
    for _ in range(8):
        step = f"list_transform([{step}], lambda c: case when c & 1 = 1 then xor(c >> 1, {POLYNOMIAL}) else c >> 1 end)[1]"
    byte = f"list_transform([xor(acc, octet)], lambda c: {step})[1]"
    start = f"list_prepend(4294967295::bigint, {octets})"
    return f"cast(xor(list_reduce({start}, lambda acc, octet: {byte}), 4294967295) as bigint)"


def base_score_sql() -> str:
    """op3's counts and base score, rounded to four places: a sum of doubles depends on its order."""
    digits = "list_transform(range(1, cast(len(cast(doc_id as varchar)) as bigint) + 1), lambda i: ascii(substr(cast(doc_id as varchar), i, 1))::bigint)"
    return rf"""
        with d as (
            select doc_id, {crc32_sql(digits)} % 7 = 2 as held_out,
                list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}'), ' ') as tokens
            from documents
        ), t as (select row_number() over () as place, * from d),
        u as (select place, held_out, unnest(tokens) as token from t),
        c as (select token, count(*) as c from u where not held_out group by token),
        n as (select cast(coalesce(sum(c), 0) as bigint) as train_tokens, count(*) as v from c),
        s as (
            select place, cast(count(*) as bigint) as n_tokens, cast(count(c.c) as bigint) as n_known,
                sum(log10((coalesce(c.c, 0) + 1)::double / (n.train_tokens + n.v + 1))) as base
            from u left join c using (token) cross join n group by place
        )
        select doc_id, held_out, n_tokens, n_known, train_tokens, round(base, 4) as base_score from t join s using (place) cross join n"""


def payload_sql() -> str:
    """op4's payload: sizes, SHA-256 and the CRC-32 of the last 64 bytes."""
    octets = "list_transform(range(64), lambda i: ('0x' || substr(last, 2 * i + 1, 2))::bigint)"
    return rf"""
        with d as (select doc_id, encode(coalesce(text, '')) as raw from documents),
        p as (select *, octet_length(raw) as n, greatest(64, (octet_length(raw) + 63) // 64 * 64) as m from d),
        q as (select *, unhex(hex(raw) || repeat('00', m - n)) as payload, right(hex(raw) || repeat('00', m - n), 128) as last from p)
        select doc_id, cast(n as bigint) as n_bytes, cast(m as bigint) as payload_bytes, sha256(payload) as payload_sha256, {crc32_sql(octets)} as tail_crc32 from q"""


def base_counts_sql() -> str:
    """op8's base counts."""
    return rf"""
        with d as (select row_number() over () as place, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
        w as (select place, generate_subscripts(words, 1) as i, unnest(words) as a from d),
        g as (select *, lead(a, 1) over o as b, lead(a, 2) over o as c from w window o as (partition by place order by i)),
        r as (select *, c is not null and count(*) over (partition by place, a, b, c) > 1 as again from g),
        k as (select place, again or coalesce(lag(again, 1) over o, false) or coalesce(lag(again, 2) over o, false) as inside from r window o as (partition by place order by i)),
        n as (select place, count(*) filter (inside) as n_repeat_words from k group by place),
        l as (select place, unnest(string_split(text, chr(10))) as line from d),
        e as (select place, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '{WORD}') group by place),
        f as (
            select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
                cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
                cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
            from d left join n using (place) left join e using (place)
        )
        select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f"""
