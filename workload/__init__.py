"""The registered queries: each reads the given tables and has, where SQL can say it, an oracle."""
