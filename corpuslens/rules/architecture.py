"""Architecture rules."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

DIRECTORY_SETS = {
    "MVC": [
        ("models/", "views/", "controllers/"), ("model/", "view/", "controller/"),
        ("app/models/", "app/views/", "app/controllers/"),
        ("src/models/", "src/views/", "src/controllers/"), ("Models/", "Views/", "Controllers/"),
    ],
    "MVVM": [
        ("models/", "views/", "viewmodels/"), ("model/", "view/", "viewmodel/"),
        ("app/models/", "app/views/", "app/viewmodels/"),
        ("src/models/", "src/views/", "src/viewmodels/"), ("Models/", "Views/", "ViewModels/"),
    ],
    "MVP": [
        ("models/", "views/", "presenters/"), ("model/", "view/", "presenter/"),
        ("app/models/", "app/views/", "app/presenters/"),
        ("src/models/", "src/views/", "src/presenters/"), ("Models/", "Views/", "Presenters/"),
    ],
    "Layered Architecture": [
        ("presentation/", "business/", "data/"), ("presentation/", "service/", "repository/"),
        ("ui/", "core/", "data/"), ("ui/", "domain/", "data/"),
        ("frontend/", "backend/", "database/"), ("api/", "services/", "repositories/"),
        ("controllers/", "services/", "repositories/"), ("web/", "service/", "persistence/"),
    ],
    "Clean Architecture": [
        ("entities/", "usecases/", "adapters/", "frameworks/"),
        ("domain/", "application/", "infrastructure/", "presentation/"),
        ("core/domain/", "core/application/", "infrastructure/", "ui/"),
        ("domain/entities/", "domain/usecases/", "data/", "presentation/"),
    ],
    "Hexagonal Architecture": [
        ("domain/", "ports/", "adapters/"), ("core/", "ports/", "adapters/"),
        ("domain/", "application/ports/", "infrastructure/adapters/"),
        ("internal/", "interfaces/", "external/"),
    ],
    "Microservices": [
        ("services/", "discovery/", "gateway/"),
        ("microservices/", "api-gateway/", "service-registry/"), ("ms-", "api-gateway/", "eureka/"),
        ("svc-", "gateway/", "registry/"),
    ],
    "Event-Driven Architecture": [
        ("events/", "handlers/", "publishers/"), ("events/", "subscribers/", "publishers/"),
        ("events/", "consumers/", "producers/"), ("messages/", "handlers/", "dispatchers/"),
    ],
    "Domain-Driven Design": [
        ("domain/entities/", "domain/valueobjects/", "domain/repositories/"),
        ("domain/aggregates/", "domain/services/", "domain/events/"),
        ("domain/model/", "domain/service/", "infrastructure/persistence/"),
        ("core/aggregates/", "core/repositories/", "infrastructure/"),
    ],
    "CQRS": [
        ("commands/", "queries/", "handlers/"), ("write/", "read/", "models/"),
        ("command/", "query/", "projections/"), ("commands/", "queries/", "events/"),
    ],
    "REST API": [
        ("controllers/", "services/", "repositories/"),
        ("resources/", "services/", "repositories/"), ("api/v1/", "services/", "repositories/"),
        ("endpoints/", "services/", "data/"),
    ],
    "GraphQL API": [
        ("graphql/", "resolvers/", "schema/"),
        ("graphql/resolvers/", "graphql/types/", "graphql/schema/"),
        ("graphql/", "resolvers/", "models/"), ("schema/", "resolvers/", "models/"),
    ],
    "Feature-based architecture": [
        ("features/", "shared/", "utils/"), ("modules/", "shared/", "common/"),
        ("features/", "common/", "core/"), ("modules/", "common/", "core/"),
    ],
}

FILE_PATTERNS = {
    "MVC": [
        r"(\w+)Controller\.\w+", r"(\w+)View\.\w+", r"(\w+)Model\.\w+", r"controllers/(\w+)\.\w+",
        r"views/(\w+)\.\w+", r"models/(\w+)\.\w+",
    ],
    "MVVM": [
        r"(\w+)ViewModel\.\w+", r"(\w+)View\.\w+", r"(\w+)Model\.\w+", r"viewmodels/(\w+)\.\w+",
        r"views/(\w+)\.\w+", r"models/(\w+)\.\w+",
    ],
    "Clean Architecture": [
        r"(\w+)UseCase\.\w+", r"(\w+)Entity\.\w+", r"(\w+)Repository\.\w+", r"usecases/(\w+)\.\w+",
        r"entities/(\w+)\.\w+", r"repositories/(\w+)\.\w+",
    ],
    "Hexagonal Architecture": [
        r"(\w+)Port\.\w+", r"(\w+)Adapter\.\w+", r"(\w+)Service\.\w+", r"ports/(\w+)\.\w+",
        r"adapters/(\w+)\.\w+", r"domain/(\w+)\.\w+",
    ],
    "Domain-Driven Design": [
        r"(\w+)Entity\.\w+", r"(\w+)ValueObject\.\w+", r"(\w+)Aggregate\.\w+",
        r"(\w+)Repository\.\w+", r"(\w+)Factory\.\w+", r"(\w+)Service\.\w+",
    ],
    "CQRS": [
        r"(\w+)Command\.\w+", r"(\w+)Query\.\w+", r"(\w+)Handler\.\w+", r"commands/(\w+)\.\w+",
        r"queries/(\w+)\.\w+", r"handlers/(\w+)\.\w+",
    ],
    "Microservices": [
        r"(\w+)Service\.\w+", r"(\w+)Client\.\w+", r"(\w+)Api\.\w+", r"services/(\w+)/",
        r"clients/(\w+)\.\w+", r"apis/(\w+)\.\w+",
    ],
}

CODE_PATTERNS = {
    "MVC": [
        r"class\s+\w+Controller", r"class\s+\w+Model", r"extends\s+Controller", "@Controller",
        "@RequestMapping", 'render\\(\\s*[\'\\"][\\w/]+[\'\\"]\\s*,',
    ],
    "MVVM": [
        r"class\s+\w+ViewModel", r"extends\s+ViewModel", "@BindingAdapter", "LiveData<",
        "Observable<", r"setState\(",
    ],
    "Clean Architecture": [
        r"class\s+\w+UseCase", r"class\s+\w+Interactor", r"class\s+\w+Gateway", "@UseCase",
        "@Entity", "@Repository", r"implements\s+UseCase",
    ],
    "Hexagonal Architecture": [
        r"interface\s+\w+Port", r"class\s+\w+Adapter", r"implements\s+\w+Port", "@Port", "@Adapter",
        "@InboundPort", "@OutboundPort",
    ],
    "Domain-Driven Design": [
        r"class\s+\w+Entity", r"class\s+\w+ValueObject", r"class\s+\w+Aggregate",
        r"class\s+\w+Repository", r"class\s+\w+Factory", r"class\s+\w+Service", "@Entity",
        "@AggregateRoot", "@ValueObject", "@DomainService",
    ],
    "CQRS": [
        r"class\s+\w+Command", r"class\s+\w+Query", r"class\s+\w+Handler",
        r"class\s+\w+CommandHandler", r"class\s+\w+QueryHandler", "@CommandHandler",
        "@QueryHandler", "@EventHandler",
    ],
    "Event-Driven Architecture": [
        r"class\s+\w+Event", r"class\s+\w+EventHandler", r"class\s+\w+Publisher",
        r"class\s+\w+Subscriber", "@EventListener", "@Subscribe", r"emit\(",
    ],
    "REST API": [
        "@RestController", "@GetMapping", "@PostMapping", "@RequestBody", "@PathVariable",
        "@RequestParam", r"app\.get\(", r"app\.post\(",
    ],
    "GraphQL API": [
        r"type\s+\w+\s*{", r"input\s+\w+\s*{", r"interface\s+\w+\s*{", "@Query", "@Mutation",
        "@Resolver", "gql`", "graphql`",
    ],
}

# Path substrings that reveal a convention: (architecture, points, how many must be present, which
# of the indicators count, evidence).
CONVENTIONS = [
    ("MVC", 30, 3, ["app/models/", "app/controllers/", "app/views/"], "Found Ruby on Rails MVC structure"),
    ("MVC", 30, 3, ["models.py", "views.py", "urls.py"], "Found Django MTV structure"),
    ("MVC", 30, 3, ["app/Models/", "app/Http/Controllers/", "resources/views/"], "Found Laravel MVC structure"),
    ("Layered Architecture", 25, 3, ["controller/", "service/", "repository/", "model/", "entity/"],
     "Found Spring Boot layered architecture"),
    ("MVVM", 20, 1, ["app.module.ts", "app.component.ts", "app.component.html", "app.service.ts"],
     "Found Angular MVVM-influenced structure"),
    ("MVVM", 20, 3, ["reducers/", "actions/", "store.js", "App.jsx", "App.tsx"],
     "Found React with Redux structure"),
    ("MVC", 30, 3, ["Controllers/", "Views/", "Models/", "ViewModels/"], "Found ASP.NET MVC structure"),
    ("Microservices", 25, 3,
     ["docker-compose.yml", "kubernetes/", "k8s/", "helm/", "service-discovery/", "api-gateway/",
      "gateway/", "eureka/", "consul/", "services/"], "Found {count} microservice indicators"),
]

# Path substrings checked by the corrections; the last two lists are compared in lower case.
MICROSERVICE_SIGNS = [
    "docker-compose.yml", "docker-compose.yaml", "kubernetes", "k8s", "helm", "istio", "api-gateway",
    "service-discovery", "eureka", "consul",
]
EVENT_SIGNS = ["kafka", "rabbitmq", "activemq", "nats", "eventbus", "event-bus", "event_bus", "events"]
REST_SIGNS = ["swagger", "openapi", "endpoints", "controllers", "api/v1", "api/v2", "resources"]

# Path substrings (lower case) that make a file count as one component of an architecture.
COMPONENTS = {
    "models": ["model"],
    "views": ["view"],
    "controllers": ["controller"],
    "viewmodels": ["viewmodel"],
    "entities": ["entity", "/entities/", "/domain/model"],
    "usecases": ["usecase", "/application/"],
    "adapters": ["adapter", "/infrastructure/"],
}

# Directory names that are never feature modules.
GENERIC_DIRECTORIES = ["src", "app", "test", "tests", "build", "dist", "node_modules"]
