"""The eight user-level calls, composed from sources and operators."""
