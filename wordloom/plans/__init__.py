"""The engine facade, and the same queries as SQL."""
