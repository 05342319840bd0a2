"""Results that grow as files arrive."""
