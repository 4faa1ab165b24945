"""Database rules."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

URLS = {
    "MySQL": [
        "mysql://", "jdbc:mysql", r"mysql://[a-zA-Z0-9:@\.\-_]+/[a-zA-Z0-9_]+",
        'host\\s*=\\s*[\'\\"].*?[\'\\"].*?database\\s*=\\s*[\'\\"].*?[\'\\"]',
        "(?:DB_HOST|MYSQL_HOST)",
    ],
    "PostgreSQL": [
        "postgres(?:ql)?://", "jdbc:postgresql", "psql://",
        r"postgres(?:ql)?://[a-zA-Z0-9:@\.\-_]+/[a-zA-Z0-9_]+", "(?:DB_HOST|POSTGRES_HOST)",
    ],
    "SQLite": ["sqlite:///", "jdbc:sqlite", '\\.db(?:3)?[\'\\"]', "(?:DB_PATH|SQLITE_DATABASE)"],
    "MongoDB": [
        r"mongodb(?:\+srv)?://", r"mongodb(?:\+srv)?://[a-zA-Z0-9:@\.\-_]+/[a-zA-Z0-9_]+",
        "(?:MONGO_URI|MONGODB_URI)",
    ],
    "Redis": ["redis://", r"redis://[a-zA-Z0-9:@\.\-_]+(?::[0-9]+)?", "(?:REDIS_URL|REDIS_HOST)"],
    "Oracle": [
        "oracle://", "jdbc:oracle", 'sid\\s*=\\s*[\'\\"].*?[\'\\"]', "(?:ORACLE_SID|ORACLE_HOST)",
    ],
    "SQL Server": ["mssql://", "jdbc:sqlserver", "sqlserver://", "(?:MSSQL_HOST|SQL_SERVER)"],
    "Cassandra": ["cassandra://", "jdbc:cassandra", r"contactPoints\s*="],
    "Elasticsearch": ["elasticsearch://", r"http[s]?://[a-zA-Z0-9\.\-_]+:9200"],
    "DynamoDB": ["dynamodb://", "aws_access_key_id.*?aws_secret_access_key", "AWS::DynamoDB"],
    "Firebase": [
        r"firebaseio\.com", "apiKey.*?authDomain.*?databaseURL", r"firebase\.initializeApp",
    ],
    "Neo4j": ["neo4j://", "bolt://", "jdbc:neo4j"],
}

DRIVERS = {
    "MySQL": [
        r"mysql\.connector", "pymysql", r"import\s+mysql", 'require\\([\'\\"]mysql[\'\\"]',
        'gem [\'\\"]mysql2[\'\\"]', "jdbc/mysql", "MySqlClient", "MySqlConnection",
    ],
    "PostgreSQL": [
        r"import\s+psycopg2", 'require\\([\'\\"]pg[\'\\"]', 'gem [\'\\"]pg[\'\\"]',
        "jdbc/postgresql", "PostgresClient", "PostgresConnection", "Npgsql", r"import\s+pg",
        r"from\s+pg\s+import",
    ],
    "SQLite": [
        r"import\s+sqlite3", 'require\\([\'\\"]sqlite3[\'\\"]', 'gem [\'\\"]sqlite3[\'\\"]',
        "jdbc/sqlite", "SqliteConnection", "SqliteDatabase",
    ],
    "MongoDB": [
        r"import\s+pymongo", r"from\s+pymongo", 'require\\([\'\\"]mongodb[\'\\"]', "mongoose",
        "MongoClient", "MongoDatabase", r"MongoDB\.",
    ],
    "Redis": [
        r"import\s+redis", r"from\s+redis", 'require\\([\'\\"]redis[\'\\"]',
        'gem [\'\\"]redis[\'\\"]', "RedisClient", r"createClient\(\)",
    ],
    "Oracle": [
        r"import\s+cx_Oracle", 'require\\([\'\\"]oracledb[\'\\"]', 'gem [\'\\"]ruby-oci8[\'\\"]',
        "jdbc/oracle", "OracleConnection",
    ],
    "SQL Server": [
        r"import\s+pyodbc", r"import\s+pymssql", 'require\\([\'\\"]mssql[\'\\"]', "jdbc/sqlserver",
        "SqlConnection", "SqlClient",
    ],
    "Cassandra": [
        r"import\s+cassandra", r"from\s+cassandra", 'require\\([\'\\"]cassandra[\'\\"]',
        "CassandraClient", "CassandraCluster",
    ],
    "Elasticsearch": [
        r"import\s+elasticsearch", r"from\s+elasticsearch", 'require\\([\'\\"]elasticsearch[\'\\"]',
        "ElasticsearchClient",
    ],
    "DynamoDB": [
        r"import\s+boto3", r"from\s+boto3", "DynamoDBClient", r"AWS\.DynamoDB", "DocumentClient",
    ],
    "Firebase": [
        r"import\s+firebase", r"from\s+firebase", 'require\\([\'\\"]firebase[\'\\"]',
        "FirebaseDatabase", "initializeApp",
    ],
    "Neo4j": [
        r"import\s+neo4j", r"from\s+neo4j", 'require\\([\'\\"]neo4j[\'\\"]', "Neo4jClient",
        "Neo4jDriver",
    ],
}

ORMS = {
    "SQLAlchemy (Python)": [
        r"import\s+sqlalchemy", r"from\s+sqlalchemy", r"create_engine\(", r"Column\(",
        r"relationship\(", r"Base\s*=\s*declarative_base\(\)",
    ],
    "Django ORM (Python)": [
        r"from\s+django\.db\s+import\s+models", r"class\s+\w+\(models\.Model\)",
        r"models\.\w+Field\(",
    ],
    "Sequelize (JavaScript)": [
        r"const\s+sequelize\s*=\s*new\s+Sequelize", r"import\s+Sequelize", r"sequelize\.define\(",
        r"DataTypes\.",
    ],
    "TypeORM (TypeScript)": [
        r"import\s+{\s*Entity", r"@Entity\(", r"@Column\(", "@ManyToOne", "@OneToMany",
        r"createConnection\(",
    ],
    "Hibernate (Java)": [
        r"import\s+javax\.persistence", r"import\s+org\.hibernate", "@Entity", "@Table", "@Column",
        "SessionFactory",
    ],
    "Prisma (JavaScript/TypeScript)": [
        r"import\s+{\s*PrismaClient", r"const\s+prisma\s*=\s*new\s+PrismaClient",
        r"prisma\.\w+\.findMany", r"prisma\.\w+\.create",
    ],
    "Entity Framework (C#)": [
        r"using\s+Microsoft\.EntityFrameworkCore", "DbContext", "DbSet<", "OnModelCreating",
    ],
    "Mongoose (JavaScript)": [
        r"import\s+mongoose", 'const\\s+mongoose\\s*=\\s*require\\([\'\\"]mongoose[\'\\"]\\)',
        r"mongoose\.Schema", r"mongoose\.model\(",
    ],
    "ActiveRecord (Ruby)": [
        r"class\s+\w+\s*<\s*ApplicationRecord", r"class\s+\w+\s*<\s*ActiveRecord::Base",
        r"has_many\s+:", r"belongs_to\s+:",
    ],
    "GORM (Go)": [
        r'import\s+\"gorm\.io/gorm\"', r"db\s*:=\s*gorm\.Open\(",
        r"type\s+\w+\s+struct\s+{[\s\S]*?`gorm:",
    ],
}

QUERIES = {
    "SQL": [
        r"SELECT\s+[\w\*]+\s+FROM\s+\w+", r"INSERT\s+INTO\s+\w+", r"UPDATE\s+\w+\s+SET",
        r"DELETE\s+FROM\s+\w+", r"CREATE\s+TABLE\s+\w+", r"ALTER\s+TABLE\s+\w+",
    ],
    "MySQL-specific": [r"SHOW\s+DATABASES", r"SHOW\s+TABLES", r"ENGINE\s*=\s*InnoDB"],
    "PostgreSQL-specific": [r"CREATE\s+EXTENSION", "::jsonb", r"WITH\s+RECURSIVE"],
    "MongoDB Query": [
        r"\{\s*\$match", r"\{\s*\$group", r"\{\s*\$lookup", r"\.find\(\{", r"\.aggregate\(\[",
    ],
    "Elasticsearch Query": [
        r'\"query\":\s*\{', r'\"bool\":\s*\{', r'\"must\":\s*\[', r'\"match\":\s*\{',
        r'\"term\":\s*\{',
    ],
    "GraphQL": [r"query\s*\{", r"mutation\s*\{", r"type\s+\w+\s*\{", r"fragment\s+\w+\s+on"],
}

CONFIG_FILES = {
    "MySQL": [r"my\.cnf", "mysql-config", r"mysqld\.conf"],
    "PostgreSQL": [r"pg_hba\.conf", r"postgresql\.conf", r"postgres\.(json|yaml|yml)"],
    "SQLite": [r"\.sqlite3?-journal", r"\.db-journal"],
    "MongoDB": [r"mongod\.conf", r"mongo\.(json|yaml|yml)"],
    "Redis": [r"redis\.conf", r"redis\.(json|yaml|yml)"],
    "Elasticsearch": [r"elasticsearch\.yml", r"elastic\.(json|yaml|yml)"],
    "Cassandra": [r"cassandra\.yaml", r"cassandra-env\.sh"],
}

CONNECTIONS = {
    "MySQL": [
        r"mysql\.connect\(", r"MySqlConnection\(", r"new\s+MySqlConnection\(",
        r"mysql\.createConnection\(", r"createPool\(",
    ],
    "PostgreSQL": [
        r"psycopg2\.connect\(", r"pg\.connect\(", r"new\s+Pool\(", r"new\s+Client\(",
        r"NpgsqlConnection\(",
    ],
    "SQLite": [r"sqlite3\.connect\(", r"new\s+SqliteConnection\(", r"openDatabase\("],
    "MongoDB": [r"MongoClient\(", r"mongoose\.connect\(", r"mongodb\.MongoClient\."],
    "Redis": [r"redis\.createClient\(", r"new\s+RedisClient\(", r"Redis\.new\("],
    "Elasticsearch": [r"new\s+elasticsearch\.Client\(", r"new\s+Client\(\{", r"Elasticsearch\("],
    "DynamoDB": [r"new\s+AWS\.DynamoDB\(", r"DynamoDBClient\(", r"DynamoDBDocument\("],
}

# Query dialect -> (database, points per match, evidence label).
QUERY_TARGETS = {
    "SQL": ("SQL Database", 2, "SQL Query"),
    "MySQL-specific": ("MySQL", 5, "MySQL Query"),
    "PostgreSQL-specific": ("PostgreSQL", 5, "PostgreSQL Query"),
    "MongoDB Query": ("MongoDB", 5, "MongoDB Query"),
    "Elasticsearch Query": ("Elasticsearch", 5, "Elasticsearch Query"),
    "GraphQL": ("GraphQL", 3, "GraphQL"),
}

# ORM -> (database, points per match, words of which one must be in the file, words that must not).
ORM_ROUTES = {
    "SQLAlchemy (Python)": [
        ("MySQL", 5, ["mysql"], []),
        ("PostgreSQL", 5, ["postgres"], []),
        ("SQLite", 5, ["sqlite"], []),
    ],
    "Django ORM (Python)": [
        ("PostgreSQL", 5, ["postgresql", "psycopg2"], []),
        ("MySQL", 5, ["mysql"], ["postgresql", "psycopg2"]),
        ("SQLite", 5, [], ["postgresql", "psycopg2", "mysql"]),
    ],
    "Mongoose (JavaScript)": [("MongoDB", 5, [], [])],
    "Sequelize (JavaScript)": [("PostgreSQL", 5, ["postgres"], []), ("MySQL", 5, [], ["postgres"])],
    "Prisma (JavaScript/TypeScript)": [
        ("PostgreSQL", 5, ["postgres"], []),
        ("MySQL", 5, [], ["postgres"]),
    ],
    "Hibernate (Java)": [("SQL Database", 3, [], [])],
    "Entity Framework (C#)": [("SQL Database", 3, [], [])],
    "ActiveRecord (Ruby)": [("PostgreSQL", 3, [], []), ("MySQL", 2, [], [])],
    "GORM (Go)": [("PostgreSQL", 3, [], [])],
}

# Environment variables of container files, and dependencies of manifests.
CONTAINER_VARIABLES = {
    "MySQL": r"MYSQL_ROOT_PASSWORD|MYSQL_DATABASE|MYSQL_USER|MYSQL_PASSWORD",
    "PostgreSQL": r"POSTGRES_PASSWORD|POSTGRES_USER|POSTGRES_DB|PGDATA",
    "MongoDB": r"MONGO_INITDB_ROOT_USERNAME|MONGO_INITDB_ROOT_PASSWORD|MONGO_INITDB_DATABASE",
    "Redis": r"REDIS_PASSWORD|REDIS_PORT|REDIS_HOST",
}
NPM_PACKAGES = {
    "MySQL": r'"mysql"|"mysql2"',
    "PostgreSQL": r'"pg"|"postgres"',
    "MongoDB": r'"mongodb"|"mongoose"',
    "Redis": r'"redis"',
    "Elasticsearch": r'"elasticsearch"|"@elastic/elasticsearch"',
}
PYTHON_PACKAGES = {
    "MySQL": r"mysql-connector|pymysql",
    "PostgreSQL": r"psycopg2|psycopg2-binary",
    "MongoDB": r"pymongo|mongoengine",
    "Redis": r"redis",
    "Elasticsearch": r"elasticsearch",
}

# Databases that outrank the generic "SQL Database", in the order they are compared.
SPECIFIC_SQL = ["MySQL", "PostgreSQL", "SQLite", "SQL Server", "Oracle"]
