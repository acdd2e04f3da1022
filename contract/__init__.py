"""Driver contract: the test tables as events, the registered queries, their SQL."""
