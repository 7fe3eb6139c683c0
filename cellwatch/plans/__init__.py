"""The batch job, the registered queries and their SQL counterparts."""
