"""Operators put together: the log facade, the tools, the registered queries."""
