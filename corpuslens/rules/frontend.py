"""Frontend rules."""

# Technology names, patterns and their order decide the scores, so they are
# stated here exactly as the detection results need them.

FRAMEWORK_FILES = {
    "React": ["jsx", "tsx", ".jsx", ".tsx", "react.js", "react.min.js", "react-dom.js"],
    "Vue.js": [".vue", "vue.js", "vue.min.js", "vue.config.js", "vue.config.ts"],
    "Angular": ["angular.json", ".angular-cli.json", "ng-app", "app.module.ts"],
    "Svelte": [".svelte", "svelte.config.js", "rollup-plugin-svelte"],
    "Next.js": ["next.config.js", "pages/_app.js", "pages/_document.js", "pages/index.js"],
    "Nuxt.js": ["nuxt.config.js", "layouts/default.vue", "pages/index.vue"],
    "Gatsby": ["gatsby-config.js", "gatsby-node.js", "gatsby-browser.js"],
    "Preact": ["preact.js", "preact.min.js", "preact.config.js"],
    "Ember.js": ["ember-cli-build.js", "app/templates/", "app/routes/"],
    "Backbone.js": ["backbone.js", "backbone.min.js"],
    "jQuery": ["jquery.js", "jquery.min.js"],
    "Alpine.js": ["alpine.js", "alpine.min.js", "x-data", "x-bind"],
    "Lit": ["lit-element", "lit-html", "LitElement"],
    "Solid.js": ["solid-js", ".solid", "createSignal", "createEffect"],
    "Web Components": ["customElements.define", "attachShadow"],
}

CSS_FILES = {
    "Bootstrap": [
        "bootstrap.css", "bootstrap.min.css", "bootstrap.js", "bootstrap.min.js",
        "bootstrap.bundle.js",
    ],
    "Tailwind CSS": [
        "tailwind.config.js", "tailwind.css", "tailwind.min.css", "tailwind.config.cjs",
    ],
    "Material-UI": ["@material-ui", "@mui/material", "createTheme", "ThemeProvider"],
    "Chakra UI": ["@chakra-ui", "ChakraProvider", "useDisclosure"],
    "Ant Design": ["antd", "@ant-design", "ConfigProvider", "Layout"],
    "Semantic UI": ["semantic.css", "semantic.min.css", "semantic.js", "semantic.min.js"],
    "Bulma": ["bulma.css", "bulma.min.css", "bulma-extensions"],
    "Foundation": ["foundation.css", "foundation.min.css", "foundation.js", "foundation.min.js"],
    "Materialize": [
        "materialize.css", "materialize.min.css", "materialize.js", "materialize.min.js",
    ],
    "Styled Components": ["styled-components", "createGlobalStyle", "css`"],
    "Emotion": ["@emotion/react", "@emotion/styled", "css`"],
    "SASS/SCSS": [".scss", ".sass", "sass", "node-sass"],
    "LESS": [".less", "less", "less-loader"],
    "PostCSS": ["postcss.config.js", "postcss.config.cjs", "postcss.js", "autoprefixer"],
    "CSS Modules": [".module.css", ".module.scss", ".module.sass", ".module.less"],
}

STATE_FILES = {
    "Redux": ["redux", "createStore", "combineReducers", "applyMiddleware", "connect"],
    "MobX": ["mobx", "observable", "action", "computed", "observer"],
    "Vuex": ["vuex", "createStore", "state", "mutations", "actions", "getters"],
    "Pinia": ["pinia", "defineStore", "createPinia"],
    "Recoil": ["recoil", "atom", "selector", "useRecoilState", "useRecoilValue"],
    "Jotai": ["jotai", "atom", "useAtom", "useAtomValue"],
    "Zustand": ["zustand", "create", "useStore"],
    "XState": ["xstate", "createMachine", "interpret", "useMachine"],
    "Context API": ["createContext", "useContext", "Provider", "Consumer"],
    "NgRx": ["@ngrx/store", "createReducer", "createAction", "createEffect"],
    "RxJS": ["rxjs", "Observable", "Subject", "BehaviorSubject", "pipe"],
    "Apollo Client": ["@apollo/client", "ApolloClient", "useQuery", "useMutation"],
    "SWR": ["swr", "useSWR", "mutate", "SWRConfig"],
    "React Query": ["react-query", "useQuery", "useMutation", "QueryClient"],
}

COMPONENT_FILES = {
    "Material UI": ["@material-ui", "@mui/material", "makeStyles", "createTheme"],
    "Chakra UI": ["@chakra-ui", "ChakraProvider", "useDisclosure"],
    "Ant Design": ["antd", "@ant-design", "Form", "Button", "Table"],
    "React Bootstrap": ["react-bootstrap", "Navbar", "Container", "Row", "Col"],
    "Blueprint": ["@blueprintjs", "Button", "Popover", "Dialog"],
    "Mantine": ["@mantine", "MantineProvider", "createStyles"],
    "Headless UI": ["@headlessui", "Transition", "Dialog", "Disclosure"],
    "Radix UI": ["@radix-ui", "DialogRoot", "PopoverContent"],
    "PrimeReact": ["primereact", "DataTable", "InputText", "Calendar"],
    "NgBootstrap": ["@ng-bootstrap", "NgbModule", "NgbModal"],
    "Angular Material": ["@angular/material", "MatButton", "MatDialog"],
    "Vuetify": ["vuetify", "v-app", "v-btn", "v-card"],
    "Quasar": ["quasar", "QBtn", "QCard", "QInput"],
    "PrimeVue": ["primevue", "DataTable", "InputText", "Calendar"],
    "Element Plus": ["element-plus", "el-button", "el-form", "el-table"],
}

TESTING_FILES = {
    "Jest": ["jest.config.js", "jest.config.ts", "jest.setup.js", "test.js", "spec.js", "expect"],
    "Testing Library": [
        "@testing-library/react", "@testing-library/vue", "render", "screen", "fireEvent",
    ],
    "Cypress": ["cypress.json", "cypress.config.js", "cypress/integration", "cy.visit", "cy.get"],
    "Playwright": ["playwright.config.js", "page.goto", "page.click", "expect(page)"],
    "Selenium": ["selenium-webdriver", "webdriver", "By.", "driver.findElement"],
    "Storybook": [".storybook", "stories.js", "stories.ts", "stories.mdx", "storiesOf"],
    "Vitest": ["vitest.config.js", "vitest.config.ts", "import { test } from 'vitest'"],
}

CONTENT = {
    "React": [
        r"import\s+React", 'from\\s+[\'\\"]react[\'\\"]', r"React\.Component",
        r"extends\s+Component", "useState", "useEffect", r"<\w+\s+/>",
    ],
    "Vue.js": [
        r"import\s+Vue", 'from\\s+[\'\\"]vue[\'\\"]', r"new\s+Vue\(\{", "createApp", "<template>",
        "v-if", "v-for", "v-model", "v-on",
    ],
    "Angular": [
        r"import\s+{\s*Component", 'from\\s+[\'\\"]@angular/core[\'\\"]', r"@Component\(\{",
        r"@NgModule\(\{", r"@Injectable\(\{", "[(ngModel)]",
    ],
    "Svelte": ["<script>", r"export\s+let", "{#if", "{#each", "{:else}", "on:click", "bind:"],
    "Bootstrap": [
        r'class=\"[^\"]*btn[^\"]*\"', r'class=\"[^\"]*col-[^\"]*\"', r'class=\"[^\"]*row[^\"]*\"',
        r'class=\"[^\"]*container[^\"]*\"',
    ],
    "Tailwind CSS": [
        r'class=\"[^\"]*bg-[^\"]*\"', r'class=\"[^\"]*text-[^\"]*\"', r'class=\"[^\"]*flex[^\"]*\"',
        r'class=\"[^\"]*p-[^\"]*\"', r'class=\"[^\"]*m-[^\"]*\"',
    ],
    "Redux": [
        "createStore", "combineReducers", "useSelector", "useDispatch", "mapStateToProps",
        r"connect\(",
    ],
    "MobX": [
        "observable", "action", "computed", "observer", "makeObservable", "makeAutoObservable",
    ],
    "Material UI": [
        r"import\s+{\s*Button", 'from\\s+[\'\\"]@mui/material[\'\\"]',
        'from\\s+[\'\\"]@material-ui/core[\'\\"]', "makeStyles", "createTheme",
    ],
}

DJANGO_TEMPLATE = [
    r"{%\s+.+\s+%}", r"{{\s+.+\s+}}", "{% extends", "{% block", "{% include",
    r"from django\.template", r"from django\.shortcuts import render",
]

ANGULAR_SPECIFIC = [
    "@angular/core", r"@Component\(\{", r"@NgModule\(\{", r"platformBrowserDynamic\(\)",
    r"Angular\.(module|bootstrap)",
]

TAILWIND_SPECIFIC = [
    r"tailwind\.config\.js", r"@tailwind\s+base", r"@tailwind\s+components",
    r"@tailwind\s+utilities", 'require\\([\'\\"]tailwindcss[\'\\"]',
]

# Package name of a manifest -> (technology, sub-category).
DEPENDENCIES = {
    "react": ("React", "framework"),
    "vue": ("Vue.js", "framework"),
    "@angular/core": ("Angular", "framework"),
    "svelte": ("Svelte", "framework"),
    "next": ("Next.js", "framework"),
    "nuxt": ("Nuxt.js", "framework"),
    "gatsby": ("Gatsby", "framework"),
    "bootstrap": ("Bootstrap", "css"),
    "tailwindcss": ("Tailwind CSS", "css"),
    "@material-ui/core": ("Material UI", "component_library"),
    "@mui/material": ("Material UI", "component_library"),
    "@chakra-ui/react": ("Chakra UI", "component_library"),
    "antd": ("Ant Design", "component_library"),
    "react-bootstrap": ("React Bootstrap", "component_library"),
    "@blueprintjs/core": ("Blueprint", "component_library"),
    "@mantine/core": ("Mantine", "component_library"),
    "@headlessui/react": ("Headless UI", "component_library"),
    "@radix-ui/react-dialog": ("Radix UI", "component_library"),
    "primereact": ("PrimeReact", "component_library"),
    "vuetify": ("Vuetify", "component_library"),
    "quasar": ("Quasar", "component_library"),
    "redux": ("Redux", "state_management"),
    "react-redux": ("Redux", "state_management"),
    "@reduxjs/toolkit": ("Redux", "state_management"),
    "mobx": ("MobX", "state_management"),
    "mobx-react": ("MobX", "state_management"),
    "vuex": ("Vuex", "state_management"),
    "pinia": ("Pinia", "state_management"),
    "recoil": ("Recoil", "state_management"),
    "jotai": ("Jotai", "state_management"),
    "zustand": ("Zustand", "state_management"),
    "xstate": ("XState", "state_management"),
    "@ngrx/store": ("NgRx", "state_management"),
    "rxjs": ("RxJS", "state_management"),
    "@apollo/client": ("Apollo Client", "state_management"),
    "swr": ("SWR", "state_management"),
    "react-query": ("React Query", "state_management"),
    "jest": ("Jest", "testing"),
    "@testing-library/react": ("Testing Library", "testing"),
    "@testing-library/vue": ("Testing Library", "testing"),
    "cypress": ("Cypress", "testing"),
    "playwright": ("Playwright", "testing"),
    "selenium-webdriver": ("Selenium", "testing"),
    "@storybook/react": ("Storybook", "testing"),
    "@storybook/vue": ("Storybook", "testing"),
    "vitest": ("Vitest", "testing"),
}

# Sub-categories, weakest first: a technology of several tables takes the last one.
SUB_CATEGORIES = ["other", "framework", "css", "state_management", "component_library", "testing"]
