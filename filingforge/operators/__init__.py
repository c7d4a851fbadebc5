"""DataFrame operators over filings, grids, facts and features."""
