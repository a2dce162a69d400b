"""The reference's own queries by name, and their SQL with the domain tables it reads."""

from lodestone.plans import analytics, chain, extra, more, retrieval, texts
from lodestone.plans.fixtures import with_tables

QUERIES: dict = texts.QUERIES | retrieval.QUERIES | analytics.QUERIES | more.QUERIES | extra.QUERIES | chain.QUERIES
SQL: dict = {k: with_tables(v) for k, v in (texts.SQL | retrieval.SQL | analytics.SQL | more.SQL | extra.SQL | chain.SQL).items()}
