"""The registered queries: operators applied to the driver's tables, with the SQL they must equal."""
