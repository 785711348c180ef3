"""functions of the conversational-search engine."""
