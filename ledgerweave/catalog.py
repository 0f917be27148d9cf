"""The modules whose QUERIES are registered in __spark_entry__.py."""

from .operators import answers, builders, descriptions, evidence, layout, ledger, lines, packets, segments, statements, transactions
from .plans import statement
from .sources import corpus, sinks
from .streaming import ledger_stream, subscription_stream

MODULES = (transactions, lines, descriptions, segments, statements, ledger, builders, layout, evidence, answers, packets, statement, sinks, corpus, ledger_stream, subscription_stream)
