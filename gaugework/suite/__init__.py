"""The registered queries, their dirty views and their SQL counterparts."""
