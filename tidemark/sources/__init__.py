"""Readers and writers for scripts, ledgers, journals and catalogue rows."""
