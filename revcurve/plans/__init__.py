"""Session set-up, model composition, the query registry and the SQL oracle."""
