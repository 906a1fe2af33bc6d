"""Pieces of SQL that several oracle queries share, in DuckDB's dialect."""

from __future__ import annotations


def oracle_instant(x: str) -> str:
    """A UTC TIMESTAMP of a spelled instant, null where unreadable."""
    formats = "['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%dT%H:%M:%SZ', '%d %b %Y', '%B %d, %Y', '%a, %d %b %Y %H:%M:%S GMT']"
    zone = rf"'([+-])(\d\d):(\d\d)$'"
    return (
        f"CASE WHEN regexp_full_match(trim({x}), '[0-9]{{9,11}}') THEN make_timestamp(CAST(trim({x}) AS BIGINT) * 1000000) "
        f"WHEN regexp_matches(trim({x}), '[0-9]:[0-9]{{2}}[+-][0-9]{{2}}:[0-9]{{2}}$') THEN try_strptime(regexp_replace(trim({x}), {zone}, ''), '%Y-%m-%dT%H:%M:%S') "
        f"- CAST(regexp_extract(trim({x}), {zone}, 1) || '1' AS INTEGER) * (CAST(regexp_extract(trim({x}), {zone}, 2) AS INTEGER) * INTERVAL 1 HOUR + CAST(regexp_extract(trim({x}), {zone}, 3) AS INTEGER) * INTERVAL 1 MINUTE) "
        f"ELSE try_strptime(trim({x}), {formats}) END"
    )


def oracle_ticker(x: str) -> str:
    return f"nullif(upper(trim(regexp_replace({x}, '^.*:', ''))), '')"


ORACLE_CALLS = f"""calls AS (
  SELECT transcript_id, coalesce({oracle_ticker("ticker")}, upper(split_part(transcript_id, '_', 1))) AS ticker, {oracle_instant("date")} AS instant
  FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY created_at DESC NULLS LAST, date DESC NULLS LAST, ticker DESC NULLS LAST) AS rn FROM transcripts WHERE transcript_id IS NOT NULL)
  WHERE rn = 1 AND {oracle_instant("date")} IS NOT NULL)"""


def oracle_evidence(extra: str = "1 AS one") -> str:
    return f"""ev AS (
  SELECT evidence_id, coalesce({oracle_ticker("ticker")}, {oracle_ticker("metadata['ticker']")}) AS ticker, {oracle_instant("publication_date")} AS instant, {extra}
  FROM (SELECT *, row_number() OVER (PARTITION BY evidence_id ORDER BY retrieval_timestamp DESC NULLS LAST, {oracle_instant("publication_date")} DESC NULLS LAST) AS rn FROM retrieved_evidence WHERE evidence_id IS NOT NULL)
  WHERE rn = 1 AND {oracle_instant("publication_date")} IS NOT NULL)"""
