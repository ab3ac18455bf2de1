"""Registered queries of the core operators and their SQL equivalents."""
