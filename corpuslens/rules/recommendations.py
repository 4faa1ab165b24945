"""Companion technologies: (name, reason, severity)."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

COMPANIONS = {
    "React": [
        ("React Router", "Navigation management", "medium"),
        ("Redux", "State management", "medium"), ("TypeScript", "Type safety", "medium"),
        ("Jest", "Testing framework", "high"), ("ESLint", "Code quality", "high"),
        ("Prettier", "Code formatting", "medium"),
    ],
    "Angular": [
        ("TypeScript", "Type safety (Angular requires TypeScript)", "high"),
        ("RxJS", "Reactive programming", "high"), ("NgRx", "State management", "medium"),
        ("Angular Material", "UI component library", "medium"),
        ("Jasmine", "Testing framework", "high"), ("Karma", "Test runner", "high"),
    ],
    "Vue.js": [
        ("Vue Router", "Navigation management", "medium"), ("Vuex", "State management", "medium"),
        ("TypeScript", "Type safety", "medium"), ("Jest", "Testing framework", "high"),
        ("ESLint", "Code quality", "high"), ("Vite", "Build tool", "medium"),
    ],
    "Django": [
        ("Django REST framework", "API development", "medium"), ("Celery", "Task queue", "medium"),
        ("pytest", "Testing framework", "high"), ("Black", "Code formatting", "medium"),
        ("django-debug-toolbar", "Debugging", "low"),
    ],
    "Flask": [
        ("SQLAlchemy", "ORM", "high"), ("Alembic", "Database migrations", "medium"),
        ("Marshmallow", "Serialization", "medium"), ("pytest", "Testing framework", "high"),
        ("Black", "Code formatting", "medium"),
    ],
    "Express": [
        ("Mongoose", "MongoDB ORM", "medium"), ("Sequelize", "SQL ORM", "medium"),
        ("JWT", "Authentication", "medium"), ("Mocha", "Testing framework", "high"),
        ("Chai", "Assertion library", "high"), ("ESLint", "Code quality", "high"),
    ],
    "Spring": [
        ("Spring Boot", "Simplified configuration", "high"),
        ("Spring Data JPA", "Database access", "medium"),
        ("Spring Security", "Authentication and authorization", "medium"),
        ("JUnit", "Testing framework", "high"), ("Mockito", "Mocking library", "high"),
        ("SLF4J", "Logging", "medium"),
    ],
    "FastAPI": [
        ("SQLAlchemy", "ORM", "high"), ("Pydantic", "Data validation", "high"),
        ("Alembic", "Database migrations", "medium"), ("pytest", "Testing framework", "high"),
        ("Black", "Code formatting", "medium"),
    ],
    "Python": [
        ("pytest", "Testing framework", "high"), ("Black", "Code formatting", "medium"),
        ("mypy", "Type checking", "medium"), ("pylint", "Code quality", "medium"),
        ("Poetry", "Dependency management", "medium"),
    ],
    "JavaScript": [
        ("ESLint", "Code quality", "high"), ("Prettier", "Code formatting", "medium"),
        ("Jest", "Testing framework", "high"), ("TypeScript", "Type safety", "medium"),
        ("Webpack", "Module bundling", "medium"),
    ],
    "TypeScript": [
        ("TSLint", "Code quality", "high"), ("Prettier", "Code formatting", "medium"),
        ("Jest", "Testing framework", "high"), ("tsc", "TypeScript compiler", "high"),
    ],
    "Java": [
        ("JUnit", "Testing framework", "high"), ("Mockito", "Mocking library", "high"),
        ("SLF4J", "Logging", "medium"), ("Gradle", "Build tool", "medium"),
        ("Checkstyle", "Code quality", "medium"),
    ],
    "Go": [
        ("Go Modules", "Dependency management", "high"), ("Go Test", "Testing framework", "high"),
        ("golint", "Code quality", "medium"), ("go fmt", "Code formatting", "high"),
    ],
    "Microservices": [
        ("Docker", "Containerization", "high"), ("Kubernetes", "Container orchestration", "medium"),
        ("API Gateway", "Service aggregation", "medium"),
        ("Service Discovery", "Service location", "medium"),
        ("Distributed Tracing", "Observability", "medium"),
        ("Circuit Breaker", "Resilience", "medium"),
    ],
    "Event-Driven Architecture": [
        ("Kafka", "Event streaming", "high"), ("RabbitMQ", "Message broker", "high"),
        ("Event Store", "Event persistence", "medium"),
        ("CQRS", "Command-query separation", "medium"),
    ],
    "Serverless": [
        ("AWS Lambda", "Function execution", "high"), ("API Gateway", "API management", "high"),
        ("Serverless Framework", "Deployment management", "medium"),
        ("CloudFormation", "Infrastructure as code", "medium"),
    ],
}

FRAMEWORK_COMPANIONS = {
    "React": ["ESLint", "Prettier", "Jest", "React Router"],
    "Angular": ["TypeScript", "RxJS", "NgRx", "Angular Material"],
    "Vue.js": ["Vuex", "Vue Router", "ESLint", "Jest"],
    "Django": ["Django REST framework", "Celery", "pytest"],
    "Flask": ["SQLAlchemy", "Alembic", "pytest"],
    "Spring": ["Spring Boot", "Hibernate", "JUnit"],
    "Express": ["Mongoose", "JWT", "Mocha", "Chai"],
}

# (text, reason, severity) of the conflict and best-practice rules; their conditions are in
# ``rules.conditions`` under the same keys.
CONFLICTS = {
    "jquery_react": (
        "Consider migrating from jQuery to use React's built-in DOM manipulation capabilities",
        "jQuery and React often lead to conflicting approaches to DOM manipulation", "medium"),
    "sqlite_microservices": (
        "Consider using a more robust database solution for a microservices architecture",
        "SQLite is generally not recommended for distributed microservices architectures", "medium"),
    "django_react": (
        "Consider adding Webpack or another build system to better integrate React with Django",
        "React with Django often benefits from a dedicated build pipeline", "medium"),
    "mongo_express": (
        "Consider using Mongoose as an ODM for MongoDB with Express",
        "Mongoose provides a more structured approach to MongoDB in Express applications", "medium"),
    "flask_sqlalchemy": (
        "Consider adding SQLAlchemy for database access in your Flask application",
        "SQLAlchemy is the recommended ORM for Flask applications", "medium"),
}
BEST_PRACTICES = {
    "no_git": (
        "Consider using Git for version control",
        "Version control is essential for modern software development", "high"),
    "no_tests": (
        "Consider adding a testing framework to your project",
        "Testing frameworks are crucial for maintaining code quality", "high"),
    "no_docker": (
        "Consider containerizing your application with Docker",
        "Containerization improves deployment consistency", "medium"),
    "no_docs": (
        "Consider adding documentation files (README.md)",
        "Documentation is important for project understanding", "medium"),
    "no_ci": (
        "Consider adding a CI/CD pipeline",
        "Continuous integration and deployment improve development workflow", "medium"),
}
