"""Operators for preparing training text: counting, sharding, archiving, filtering, de-duplicating, packing and searching."""
