"""What the catalogue's queries and their SQL have in common."""

# A published history of map by branch, with relevant and found documents.
BRANCHES = (
    ("original", "20260313-142804", 0.2080, 6228, 3509), ("search-prf", "20260313-223936", 0.2396, 6228, 3756),
    ("search-rm3", "20260322-123415", 0.2530, 6228, 3904), ("search-fusion", "20260322-182005", 0.2800, 6228, 4072),
)
GRID_DOCS, GRID_WINDOWS, GRID_WEIGHTS = (10, 25), (8, 16), (0.1, 0.2)
