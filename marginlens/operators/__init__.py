"""The queries: mart views, dashboard data, daily report, checks, insights, questions."""
