"""Jobs from DataFrame to DataFrame."""
