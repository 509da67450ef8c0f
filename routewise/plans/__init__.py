"""Analysis plans: master preparation, EDA, corridors, sellers, prediction,
end-to-end jobs, and the registered queries with their DuckDB oracle."""
